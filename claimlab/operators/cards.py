"""Claim cards, case contracts, catalogues and audits of what a repository publishes.

Small single-writer records: JSON files that the driver replaces atomically.  Tables of
problems are DataFrames with the columns (subject, problem); none means all is well.
"""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter
from dataclasses import dataclass
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.operators.packages import digest, verify_package
from claimlab.operators.records import replace_file, validate_cards

#: Fixed value: ids are lower-case words joined by hyphens.
CARD_ID = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")
PROBLEMS = "subject string, problem string"


def _table(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(sorted(found), PROBLEMS)


@dataclass(frozen=True)
class States:
    """The names of a register's states: the caller's data."""

    open: str
    delivered: str
    gated: str

    def names(self) -> tuple[str, str, str]:
        return self.open, self.delivered, self.gated


def card_from_form(form: dict[str, str], lists: set[str], required: set[str], card_id: str, title: str, states: States, blocker: str | None = None) -> dict:
    """A card from a form's strings: lists by line or semicolon, empty fields refused.

    ``blocker`` says what is missing where the data is not available; the card is gated.
    """
    if not CARD_ID.fullmatch(card_id.strip()):
        raise ValueError("the id is made of lower-case words joined by hyphens")
    if not title.strip():
        raise ValueError("a card needs a title")
    if blocker is not None and not blocker.strip():
        raise ValueError("a gated card says what is missing")
    parts = lambda v: [x.strip() for x in re.split(r"[;\n]", v or "") if x.strip()]
    body = {k: parts(v) if k in lists else (v or "").strip() for k, v in form.items()}
    if empty := sorted(k for k in required if not body.get(k)):
        raise ValueError("missing: " + ", ".join(empty))
    card = {"id": card_id.strip(), "title": title.strip(), "state": states.open if blocker is None else states.gated, "body": body, "finding": None}
    return card if blocker is None else {**card, "why_not_adjudicated": {"blocker": blocker.strip()}}


def card_rows(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(file, id, title, state, summary, finding, why_not_adjudicated) of the cards in a
    folder; malformed files raise."""
    rows = []
    for path in sorted(Path(folder).glob("*.json")):
        try:
            card = json.loads(path.read_text(encoding="utf-8"))
        except ValueError as e:
            raise ValueError(f"{path.name}: {e}") from e
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True)
        rows.append((path.stem, card.get("id"), card.get("title"), card.get("state"), text(card.get("summary") or card.get("title")), text(card.get("finding")), text(card.get("why_not_adjudicated"))))
    return spark.createDataFrame(rows, "file string, id string, title string, state string, summary string, finding string, why_not_adjudicated string")


def write_card(spark: SparkSession, card: dict, folder: str | Path, states: States) -> Path:
    """Write a valid card atomically, then the folder's index."""
    row = [(card.get("id"), card.get("state"), card.get("title"), json.dumps(card["finding"]) if card.get("finding") is not None else None, json.dumps(card["why_not_adjudicated"]) if card.get("why_not_adjudicated") else ("open" if card.get("state") == states.open else None))]
    checked = spark.createDataFrame(row, "id string, state string, title string, finding string, why_not_adjudicated string")
    wrong = [r["problem"] for r in validate_cards(checked, states.names(), states.delivered).collect()]
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))
    path = Path(folder) / f"{card['id']}.json"
    replace_file(path, json.dumps(card, indent=2, sort_keys=True) + "\n")
    refresh_index(spark, folder)
    return path


def refresh_index(spark: SparkSession, folder: str | Path, most: int = 120) -> Path:
    """The folder's README: what stands above ``## Cards`` stays, the table is made anew."""
    rows = card_rows(spark, folder)
    if stray := rows.where("id is null or id <> file").limit(1).collect():
        raise ValueError(f"{stray[0]['file']}.json holds the card {stray[0]['id']!r}")
    cell = lambda c: F.replace(F.substring(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "), 1, most), F.lit("|"), F.lit("\\|"))
    lines = [r["line"] for r in rows.orderBy("id").select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, ("id", "summary", "state", "finding"))), F.lit(" |")).alias("line")).collect()]
    readme = Path(folder) / "README.md"
    head = readme.read_text(encoding="utf-8").partition("## Cards")[0].rstrip() if readme.exists() else "# Register"
    replace_file(readme, "\n".join([head, "", "## Cards", "", "| id | claim | state | finding |", "| --- | --- | --- | --- |", *lines]) + "\n")
    return readme


@dataclass(frozen=True)
class CaseSpec:
    """What a case promises: the files its result must have."""

    case_id: str
    folder: str
    gated: bool = False
    result_files: tuple[str, ...] = ()
    needed: tuple[str, ...] = ()
    gaps: tuple[str, ...] = ()


def case_result(spec: CaseSpec, root: str | Path, state: str) -> dict:
    """A case's record with its artifacts' digests; a missing artifact raises."""
    paths = [Path(root) / spec.folder / f for f in (*spec.result_files, *spec.needed)]
    if missing := [str(p) for p in paths if not p.is_file()]:
        raise ValueError("missing: " + ", ".join(missing))
    return {"schema_version": 1, "case_id": spec.case_id, "state": state, "protocol": {"complete": not spec.gaps, "gaps": list(spec.gaps)},
            "artifacts": [{"path": str(p.relative_to(root)), **digest(p)} for p in paths]}


def load_case_result(path: str | Path) -> dict:
    """A stored record of the known version with all its fields."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if found.get("schema_version") != 1 or {"case_id", "state", "protocol", "artifacts"} - found.keys():
        raise ValueError(f"{path}: not a case record of version 1")
    return found


def catalog_problems(spark: SparkSession, specs: list[CaseSpec]) -> DataFrame:
    """Repeated ids and folders, ids that are no ids, open cases without result files."""
    found = [(x, f"repeated {kind}") for kind, values in (("id", [s.case_id for s in specs]), ("folder", [s.folder for s in specs])) for x, n in Counter(values).items() if n > 1]
    found += [(s.case_id, "not an id") for s in specs if not CARD_ID.fullmatch(s.case_id)] + [(s.case_id, "no result files") for s in specs if not s.gated and not s.result_files]
    return _table(spark, found)


def integrity_audit(spark: SparkSession, root: str | Path, specs: list[CaseSpec], states: States, register: str = "registry", record: str = "case_result.json") -> DataFrame:
    """Everything that disagrees between catalogue, cards and stored case records."""
    root = Path(root)
    cards = {r["id"]: r for r in card_rows(spark, root / register).collect()}
    known = {s.case_id for s in specs}
    found = [(i, "card without a case") for i in cards.keys() - known] + [(i, "case without a card") for i in known - cards.keys()]
    for spec in specs:
        card = cards.get(spec.case_id)
        if card is None:
            continue
        if spec.gated:
            found += [(spec.case_id, "a gated case has a finding")] if card["state"] != states.gated or card["finding"] else []
            continue
        if card["state"] != states.delivered:
            found.append((spec.case_id, f"state is {card['state']}"))
        try:
            if load_case_result(root / spec.folder / record) != case_result(spec, root, card["state"]):
                found.append((spec.case_id, "the record is stale"))
        except (OSError, ValueError) as e:
            found.append((spec.case_id, str(e)))
    return catalog_problems(spark, specs).unionByName(_table(spark, found))


# Strings that no published file may hold.
SECRETS = r"AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,}"


def publication_audit(spark: SparkSession, root: str | Path, groups: list[dict], suffixes: tuple[str, ...] = (".csv", ".json", ".parquet"), large: int = 50_000_000) -> DataFrame:
    """Data files that no declared group covers, groups that cover nothing or are not
    approved, large files, files with key-like strings; files are read by the executors."""
    root = Path(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}")
    seen = files.select(F.expr(f"substring(path, {len(f'file:{root}') + 2})").alias("name"), "length", F.decode("content", "ISO-8859-1").rlike(SECRETS).alias("secret")).collect()
    data = [r["name"] for r in seen if r["name"].endswith(suffixes)]
    covered = lambda name, g: any(fnmatch(name, p) or name.startswith(p.rstrip("/") + "/") for p in g.get("paths", ()))
    found = [(n, "not declared") for n in data if not any(covered(n, g) for g in groups)]
    found += [(str(g.get("id")), "covers nothing") for g in groups if not any(covered(n, g) for n in data)] + [(str(g.get("id")), "not approved") for g in groups if g.get("status") != "approved"]
    found += [(str(i), "repeated group") for i, n in Counter(g.get("id") for g in groups).items() if n > 1]
    found += [(r["name"], "large") for r in seen if r["length"] >= large] + [(r["name"], "holds a key") for r in seen if r["secret"]]
    return _table(spark, found)


def load_package(folder: str | Path) -> dict:
    """The documents of a package that verifies."""
    if wrong := verify_package(folder):
        raise ValueError("; ".join(wrong))
    return {p.stem: json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.json"))}


def compare_packages(one: str | Path, other: str | Path) -> dict[str, str]:
    """Unified differences of the documents, by name; equal documents are left out."""
    if Path(one).resolve() == Path(other).resolve():
        raise ValueError("a package is compared with another one")
    a, b = load_package(one), load_package(other)
    text = lambda d: json.dumps(d, indent=2, sort_keys=True, ensure_ascii=False).splitlines() if d is not None else []
    pairs = {n: difflib.unified_diff(text(a.get(n)), text(b.get(n)), Path(one).name, Path(other).name, lineterm="") for n in sorted((a.keys() | b.keys()) - {"manifest"})}
    return {n: "\n".join(d) for n, lines in pairs.items() if (d := list(lines))}


def score_protocols(scored: DataFrame, lines: DataFrame, checklist: list[tuple[str, str]], key: str) -> DataFrame:
    """(key, n_lines, n_covered, coverage, missed, by_source) from ``score_checklist``'s
    covered items; ``checklist`` has (item, source).  An item is missed where no line is
    left for it; lines beyond the covered items are additions."""
    items = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(s).alias("source")) for i, s in checklist])
    per = scored.join(lines.groupBy(key).agg(F.count("*").alias("n_lines")), key)
    sources = F.array(*[F.lit(s) for s in dict.fromkeys(s for _, s in checklist)])
    share = lambda s: F.struct(s.alias("source"), F.size(F.filter(items, lambda i: i["source"] == s)).alias("total"), F.size(F.filter(items, lambda i: (i["source"] == s) & F.array_contains("covered", i["item"]))).alias("covered"))
    return per.select(key, "n_lines", F.size("covered").alias("n_covered"), (F.size("covered") / F.lit(float(len(checklist)))).alias("coverage"), F.array_except(F.transform(items, lambda i: i["item"]), "covered").alias("missed"),
                      (F.col("n_lines") - F.size("covered")).alias("additions"), F.transform(sources, share).alias("by_source"))
