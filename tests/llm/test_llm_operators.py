"""Each operator against a brute-force version on small texts with awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from claimlab.llm import bit_slices, chat_format, components, decontaminate, merkle, mixing, quality, secrets, simhash_dedup, token_counts, token_files, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, source string, fp string, size string, bucket int, rank int, spans string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def texts(seed=1, n=40):
    rng = random.Random(seed)
    out = [sentence(rng, rng.randint(1, 120)) for _ in range(n)]
    long = sentence(rng, 4000)
    near = out[5].split()
    return [*out, None, "", " \t\n", out[3], out[3], long, long + " tail", " ".join(near[:-1]), "Ünïcödé ça déjà  vu\n\nnew  para", "a b  c", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["s1", "s2", None, "s0"][k % 4], "x", "y", 1, 2, "z") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time everything is in the cache
        got = by_id(token_counts.token_counts(docs, path, cache))
        for k, t in enumerate(texts()):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts()})
    assert token_counts.token_counts(empty, path).count() == 0


def awkward(seed, n, pieces=30):
    """Texts of letters whose lower case, composition or spacing is out of the ordinary."""
    rng = random.Random(seed)
    some = ["a", "b", "Word", "WORD", "I", "J", "\u0130", "\u01f0", "\u030c", "\u0307", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u0085", "\x1c", ".", ",", "?!", "'", "'s", "'S", "1", "\u00e9", "\u00c9", "e\u0301",
            "\u00df", "\u1e9e", "\u03a3", "\u03c2", "\u65e5", "\u2167", "\ufb01", "\u212a", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<", "|>"]
    some += [chr(c) for c in range(0x250) if len(chr(c).lower()) > 1 or len(chr(c).upper()) > 1]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, pieces))) for _ in range(n)]


def test_counts_like_the_library(monkeypatch):
    coder = token_counts.LibraryCounts(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.cuts
    some = awkward(3, 3_000)
    want = [len(coder.library.encode(t, add_special_tokens=False).ids) for t in some]
    assert coder.counts(some) == want
    monkeypatch.setattr(token_counts.slabs, "__defaults__", (4,))  # texts are cut wherever they may be
    assert coder.counts(some) == want
    assert not token_counts.LibraryCounts(public_tokenizers.path("word_bpe_49k.json")).cuts


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(docs.union(docs.where("doc_id = 7")), path, shards=5)
    rows = sorted(token_files.read_token_files(manifest).collect())
    wanted, at = [], 0
    every = sorted([*enumerate(texts()), (7, texts()[7])], key=lambda x: x[0])
    for k, t in every:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        wanted.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == wanted
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0


@pytest.mark.parametrize("slab, remembered", [(1 << 20, 100_000), (16, 50)])
def test_word_ids_like_the_library(monkeypatch, slab, remembered):
    monkeypatch.setattr(token_files, "SLAB", slab)
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    coder = token_files.WordIds(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    assert coder.wordwise
    some = [*awkward(4, 20_000), "Hello \u0130!", "X.\u0130!?", "\u0130.", "x" * 500 + " y"]
    for k in range(0, len(some), 50):
        for text, got in zip(some[k : k + 50], coder.batch(some[k : k + 50]), strict=True):
            assert b"".join(got) == coder.whole(text), repr(text)
    assert all(len(w) <= token_files.LONGEST for w in coder.known)


def test_other_tokenizers_encode_whole_texts():
    coder = token_files.WordIds(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    assert not coder.wordwise
    some = awkward(5, 300)
    assert [b"".join(x) for x in coder.batch(some)] == [coder.whole(t) for t in some]


def test_token_files_without_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(None, "no id"), (None, "no id"), (None, None), (5, "five"), (5, "again five"), (-3, "")]
    got = token_files.read_token_files(token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, shards=3)).collect()
    lengths = sorted((-(2**63) if i is None else i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == lengths
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])] == sorted(r["start"] for r in got)


def brute_simhash(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("split_over", [16_384, 2])
def test_near_duplicates(docs, empty, split_over):
    marks = [brute_simhash(t, 3) for t in texts()]
    linked = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    want = smallest_reachable(len(marks), linked)
    got = by_id(simhash_dedup.near_duplicates(docs, split_over=split_over))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{marks[k]:016x}", want[k]) for k in range(len(marks))}
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_keep_one(docs):
    found = by_id(simhash_dedup.near_duplicates(docs))
    kept = simhash_dedup.keep_one(docs.union(docs.where("doc_id = 2")), 3, 3)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in found.values()})


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 8])
def test_bit_slices_find_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    marks = base[rng.integers(0, 12, 300)]
    for b in range(6):
        marks = marks ^ (rng.integers(0, 2, 300, dtype=np.uint64) << np.uint64(b * 9))
    sizes = np.array([1, 2, 64, 65, 3, 165])
    got = {tuple(map(int, p)) for i, j in bit_slices.near_pairs(marks, sizes, radius) for p in zip(i, j, strict=True)}
    ends = np.cumsum(sizes)
    want = {(i, j) for e, s in zip(ends, sizes, strict=True) for i in range(e - s, e) for j in range(i + 1, e) if int(marks[i] ^ marks[j]).bit_count() <= radius}
    assert got == want


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:], strict=False), (100, 101), (101, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 60)}, 101: 100}


def brute_tree(text):
    """The fingerprint from its definition, and the leaves' texts."""
    import xxhash

    h = lambda level, parts: xxhash.xxh3_128(level.encode() + b"".join(parts)).digest()
    sections, rest, leaves = [], [], []
    for line in text.split("\n"):
        pieces = re.findall(r"[^.!?]{1,64}[.!?]{0,8}|[.!?]{1,8}", line)
        assert "".join(pieces) == line
        leaves += pieces
        rest.append((h("paragraph", [h("leaf", [x.encode()]) for x in pieces]), pieces))
        if int.from_bytes(rest[-1][0][:1], "big") % 8 == 0:
            sections, rest = [*sections, rest], []
    sections += [rest] if rest else []
    tops = [h("section", [d for d, _ in s]) for s in sections]
    leaf = lambda x: h("leaf", [x.encode()]).hex()[:8] + np.base_repr(len(x), 36).lower()
    body = ";".join(t.hex()[:8] + "=" + "/".join(d.hex()[:8] + ":" + ",".join(map(leaf, xs)) for d, xs in s) for t, s in zip(tops, sections, strict=True))
    return f"{h('root', tops).hex()}!{body}", Counter(leaves)


def brute_likeness(a, b):
    one, two = brute_tree(a)[1], brute_tree(b)[1]
    size = lambda c: sum(len(x) * n for x, n in c.items())
    return 1.0 if a == b else size(one & two) / max(size(one), size(two)) if size(one) or size(two) else 0.0


def test_merkle(docs, empty, spark):
    got = by_id(merkle.edit_fingerprints(docs))
    all_texts = [t or "" for t in texts()]
    for k, t in enumerate(all_texts):
        following = all_texts[(k + 1) % len(all_texts)]
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        row = got[k]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["fingerprint"] == brute_tree(t)[0] and row["edited_fingerprint"] == brute_tree(changed)[0]
        assert row["near_next"] == pytest.approx(brute_likeness(t, following)) and row["near_edited"] == pytest.approx(brute_likeness(t, changed))
    assert merkle.edit_fingerprints(empty).count() == 0
    alone = merkle.edit_fingerprints(docs.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    twice = merkle.edit_fingerprints(docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).collect()
    assert [r["near_next"] for r in twice] == [1.0, 1.0]
    missing = [(None, "one"), (None, "two"), (None, None), (4, "four"), (4, "again four")]
    rows = merkle.edit_fingerprints(spark.createDataFrame(missing, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in rows) == sorted((-(2**63) if i is None else i, len(t or "")) for i, t in missing)


def test_merkle_ranges_follow_the_ids(spark):
    """Many ranges, ids on both sides of zero, gaps: each row is followed by the next id."""
    rng = random.Random(11)
    ids = sorted(rng.sample(range(-10_000, 10_000), 900))
    frame = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string").repartition(7)
    keyed = frame.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("mark"))
    dealt = merkle.with_following(keyed, 300).collect()
    by_bucket = {}
    for r in dealt:
        by_bucket.setdefault(r["bucket"], []).append((r["guest"], r["id"]))
    nxt = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    seen = {}
    for rows in by_bucket.values():
        rows.sort()
        seen |= {a[1]: b[1] for a, b in zip(rows, rows[1:], strict=False)}
        assert [g for g, _ in rows].count(True) == 1
    assert seen == nxt and len(by_bucket) > 200


def test_merkle_branches_locate_an_edit():
    lines = [f"line {k} says so. And more." for k in range(60)]
    mark = lambda x: merkle.fingerprint("\n".join(x))
    a = mark(lines)
    assert merkle.shown(merkle.parsed(a)) == a and not merkle.differing(a, a)
    place = [(i, k) for i, (_, ps) in enumerate(merkle.parsed(a)[1]) for k in range(len(ps))]
    changed = [*lines[:31], "line 31 said so.", *lines[32:]]
    assert merkle.differing(a, mark(changed)) == [place[31]]
    assert merkle.differing(a, mark(lines[:31] + lines[32:])) == [place[31]]
    assert merkle.differing(a, mark([*lines[:32], "new", *lines[32:]])) == [place[31]]
    moved = [*lines[:10], lines[20], *lines[10:20], *lines[21:]]
    assert set(merkle.differing(a, mark(moved))) == set(place[10:21])
    assert merkle.differing(a, mark([*lines, lines[5]])) == [place[59]]
    assert merkle.likeness(merkle.tree("\n".join(lines)), merkle.tree("\n".join(changed))) > 0.9
    # Leaves that agree in the digits that are shown still change the root.
    assert len({merkle.tree(t)[0] for t in ("", "\n", "a", "a\n", "\na", "a\na", "a.a", "a. a")}) == 8


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,)])
def test_mixing(spark, docs, empty, weights):
    rows = mixing.mix(docs, weights=weights).collect()
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts())}
    source = {k: ["s1", "s2", None, "s0"][k % 4] for k in sizes}
    names = sorted({s for s in source.values() if s}) + [None]
    total = {s: sum(n for k, n in sizes.items() if source[k] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, budget = dict.fromkeys(names, 0.0), 1.5 * sum(total.values())
    while budget - sum(want.values()) > 1e-6:  # share, stop at the cap, share the excess
        free = [s for s in names if want[s] < 2 * total[s] - 1e-9]
        left = budget - sum(want.values())
        for s in free:
            want[s] = min(2 * total[s], want[s] + left * weight[s] / sum(weight[x] for x in free))
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], total[s]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[s], rel=1e-6)
        taken[s] += r["taken"]
    assert len(rows) == len(sizes) and all(abs(taken[s] - want[s]) < 1.01 for s in names)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), weights=weights).collect()), key=str)
    assert mixing.mix(empty).count() == 0
    assert {r["doc_id"]: r["taken"] for r in rows} == brute_mix(spark, sizes, source, total, want)


def brute_mix(spark, sizes, source, total, want):
    """Serve one word at a time: always the source whose next word ends first."""
    places = {r["doc_id"]: r["place"] for r in spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("place")).collect()}
    queues = {s: [k for _ in range(2) for k in sorted((k for k in sizes if source[k] == s), key=lambda k: (places[k] % 2**64, k)) for _ in range(sizes[k])] for s in total}
    taken, at = dict.fromkeys(sizes, 0), dict.fromkeys(total, 0)
    for _ in range(sum(int(want[s] + 1e-6) for s in total)):
        s = min((s for s in total if at[s] < len(queues[s])), key=lambda s: (at[s] + 1) / want[s])
        taken[queues[s][at[s]]] += 1
        at[s] += 1
    return taken


def test_mix_ends_at_the_budget(docs):
    """The mix is a prefix of the order by virtual finish time."""
    _, mixed = mixing.servings(docs)
    rows = sorted(mixed.collect(), key=lambda r: r["before"])
    assert all(a["before"] + a["words"] == b["before"] and a["finish"] <= b["finish"] for a, b in zip(rows, rows[1:], strict=False))
    assert [r["taken"] > 0 for r in rows] == sorted((r["taken"] > 0 for r in rows), reverse=True)
    assert 0 < sum(r["taken"] for r in rows) < sum(r["words"] for r in rows)


def test_many_sources(spark):
    """Ranks and targets of thousands of sources."""
    rows = [(k, "word " * (k % 7 + 1), None if k == 5 else f"host{k % 1500:05d}") for k in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = Counter()
    for k, t, s in rows:
        total[s] += len(t.split())
    names = sorted(s for s in total if s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level, full = 0.0, set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        now = {s for s in names if 2 * total[s] <= weight[s] * level}
        if now == full:
            break
        full = now
    assert all(r["target"] == pytest.approx(min(2 * total[r["source"]], weight[r["source"]] * level)) for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - min(2 * total[s], weight[s] * level)) < 1.01 for s in names)


def test_mixed_documents_are_whole(docs):
    took = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert got == Counter({k: int(r["taken"] / r["size"] + 0.5) for k, r in took.items() if r["size"] and int(r["taken"] / r["size"] + 0.5)})
    again = docs.union(docs.where("doc_id = 1"))
    assert mixing.mixed_documents(again).columns == docs.columns


def test_chat_round_trip(spark):
    said = ["", None, r"\### <next/> </turn>" + "\n", "<turn role=user>\n", "\n\nx", r"\s\l\g\\", "plain"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "we<ird>\\", None]), rng.choice(said), "x") for c in range(25) for t in range(rng.randint(1, 7))]
    rows += [(99, 0, "user", "same", "x")] * 2 + [(None, 0, "user", "no id", "x")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chats).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(r, x) for _, r, x in turns] == [tuple(t) for t in got[c]["turns"]]
        assert got[c]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
    for r in chats.collect():
        assert sum(p["chars"] for p in r["mask"]) == len(r["formatted"])
        assert r["formatted"].count("<turn role=") == r["formatted"].count("</turn>")
    broken = chats.withColumn("mask", F.transform("mask", lambda m: F.struct((m["chars"] + 1).alias("chars"), m["loss"].alias("loss"))))
    with pytest.raises(Exception, match="the mask does not fit"):
        chat_format.read_back(broken).collect()
    alone = chat_format.read_back(chat_format.format_chats(spark.createDataFrame([(None, 0, "user", t) for t in "abb"], "conv_id long, turn long, role string, text string"))).collect()
    assert sorted([t["text"] for t in r["turns"]] for r in alone) == [["a"], ["b", "b"]]
    assert chat_format.chat_digests(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


BASE = {
    "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


RUNS = {"entropy_hex": r"[0-9a-fA-F]{20,}", "entropy_base64": r"[A-Za-z0-9+/_=-]{20,}"}


def entropy_spans(text, window=20):
    for kind, pattern in RUNS.items():
        for m in re.finditer(pattern, text):
            if kind == "entropy_base64" and re.fullmatch(r"[0-9a-fA-F]+", m.group()):
                continue
            begin, pieces = m.start(), []
            for x in re.finditer("|".join(f"(?:{p})" for p in secrets.ALLOW), m.group()):
                pieces.append((begin, text[begin : m.start() + x.start()]))
                begin = m.start() + x.end()
            pieces.append((begin, text[begin : m.end()]))
            for at, piece in pieces:
                hot = []
                for i in range(len(piece) - window + 1):
                    counts = Counter(piece[i : i + window])
                    bits = round(np.log2(window) - sum(n * np.log2(n) for n in counts.values()) / window, 9)
                    if bits >= secrets.THRESHOLDS[kind] and 0 < sum(counts[d] for d in "0123456789") < window:
                        hot.append(i)
                if hot:
                    yield at + hot[0], kind, at + hot[-1] + window


def test_secrets(spark):
    rng = random.Random(5)
    key = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pieces = ["password: token: abcdefghij", "Api_Key='" + key(12, b64) + "'", "secret=token=abcdefgh", "passwd = short", "AKIA" + key(12, b64[:26]), "AKIAAKIA1", "AKIA" + key(30, b64[:26]),
              key(31, hexa), key(32, hexa), key(80, hexa), "x" + key(40, hexa), key(40, b64), "a" * 50 + key(40, b64) + "b" * 30, "0123456789abcdef" * 3, "é日本", "😀", "TOKEN:\"" + key(20, b64), "long_snake_case_words_here_too", "550e8400-e29b-41d4-a716-446655440000", "\n",
              key(30, b64[:62]) + "example" + key(30, b64[:62]), "x550e8400-e29b-41d4-a716-446655440000" + key(25, hexa), key(12, b64[:62]) + "EXAMPLE" + key(12, b64[:62]), key(24, "0123456789"), "zz/" + key(40, hexa.upper())]
    rows = [(k, None if k == 0 else " ".join(rng.sample(pieces, rng.randint(0, 9))), "x") for k in range(120)]
    got = by_id(secrets.secret_digests(spark.createDataFrame(rows, "doc_id long, text string, spans string")))
    assert len(got) == 120 and any("entropy_base64" in r["spans"] for r in got.values())
    for k, text, _ in rows:
        base = []
        for kind, p in BASE.items():
            for m in p.finditer(text or ""):
                if len(m.group(1)) >= 8 if kind == "assign" else len(m.group()) >= (16 if kind == "access" else 32):
                    base.append((m.start(), list(secrets.KINDS).index(kind), m.end()))
        every = sorted(base + [(a, secrets.KINDS.index(n), b) for a, n, b in entropy_spans(text or "")])
        show = lambda spans: ",".join(f"{secrets.KINDS[n]}:{a}:{b}" for a, n, b in spans)
        assert got[k]["spans"] == show(every), text
        assert got[k]["base_sha256"] == hashlib.sha256(show(sorted(base)).encode()).hexdigest()
        assert [got[k][f"n_{n}"] for n in BASE] == [sum(s[1] == i for s in base) for i in range(3)]
    assert secrets.secret_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_in_very_long_texts(spark):
    """Time grows with the length: a run of a million characters, and 60,000 matches."""
    rng = random.Random(8)
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000)) + "Zq8Xr2Lw9Tb4Vn6Yc1Kd" + "a" * 50
    many = "AKIAABCDEFGHIJKL " * 60_000
    got = by_id(secrets.find_secrets(spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string")))
    assert [(s["kind"], s["match"]) for s in got[1]["spans"] if "Zq8Xr2Lw9Tb4Vn6Yc1Kd" in s["match"]]
    assert [(s["start"], s["kind"]) for s in got[2]["spans"]] == [(17 * k, 1) for k in range(60_000)]


def test_decontamination(spark, empty):
    rng = random.Random(6)
    items = [(k, sentence(rng, rng.randint(20, 40))) for k in range(12)] + [(50, "too short"), (51, None), (52, "same same same same same same same same")]
    rows = []
    for k in range(60):
        words = sentence(rng, rng.randint(0, 60)).split()
        if k % 2:
            item = items[k % 12][1].split()
            for _ in range(k % 3 == 2):
                item[rng.randrange(len(item))] = rng.choice(WORDS)
            if k % 7 == 0:
                item.insert(len(item) // 2, "extra")
            words[len(words) // 2 : len(words) // 2] = item if k % 3 else [w.upper() for w in item]
        rows.append((k, " ".join(words), "x"))
    rows += [(60, None, "x"), (61, items[3][1], "x"), (62, items[3][1][:40], "x"), (63, "same " * 30, "x"), (1, rows[1][1], "x")]

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for k, text, _ in rows:
        s = shingles(split(text))
        for i, t in items:
            w = split(t)
            one = Counter(shingles(w))
            n = len(w) - 4
            for at in range(max(1, len(s) - n + 1)) if one else []:
                two = Counter(s[at : at + n])
                shared = (one & two).total()
                alike = shared / (one.total() + two.total() - shared)
                if alike >= 0.8:
                    want[k, i] = max(alike, want.get((k, i), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, hashes string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 10
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {k for k, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0


def labelled(spark, n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(n):
        good, toxic = k % 4 != 0, k % 5 == 1
        words = sentence(rng, rng.randint(20, 200)).split() if good else [rng.choice(WORDS).upper() + "!!" for _ in range(rng.randint(20, 200))]
        if toxic:
            words[3:3] = rng.choices(["idiot", "scum", "moron"], k=3)
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(good), int(toxic)))
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, rows[0][1], "x"), (n + 2, rows[0][1], "x")]
    labels += [(n + 9, 1, 1), (None, 1, 1), (0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_learn_and_hold_out(spark, which):
    docs, labels = labelled(spark)
    if which == "quality":
        scored = quality.quality_scores(docs, quality.fit(docs, labels))
    else:
        scored = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels))
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[which] for r in labels.dropna().collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {k for k in truth if k is not None and zlib.crc32(str(k).encode()) % 5 == 0 and k < 400}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    flipped = labels.withColumn(which, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(which)).otherwise(F.col(which)))
    again = quality.fit(docs, flipped) if which == "quality" else toxicity.fit(docs, flipped)
    other = quality.quality_scores(docs, again) if which == "quality" else toxicity.toxicity_scores(docs, again)
    assert sorted((r["doc_id"], r["score"]) for r in rows) == sorted((r["doc_id"], r["score"]) for r in other.collect())


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_without_anything_to_learn(spark, empty, which):
    docs, labels = labelled(spark, 20)
    for d, lab in ((docs, labels.limit(0)), (empty, labels), (docs, labels.withColumn(which, F.lit(1)))):
        got = quality.quality_scores(d, quality.fit(d, lab)) if which == "quality" else toxicity.toxicity_scores(d, toxicity.fit(d, lab))
        assert got.count() == d.count()


def test_quality_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (rng.integers(1, 5), quality.N_FEATURES)) for _ in range(30)]
    labels = rng.integers(0, 2, 30).astype(float)
    model = quality.train(bags, labels, steps=3)
    x, begins = np.concatenate(bags), np.cumsum([0] + [len(b) for b in bags[:-1]])
    _, grads = quality.loss_and_gradient(model, x, begins, labels)
    for name, g in grads.items():
        flat = model.weights[name].reshape(-1)
        for at in rng.choice(len(flat), min(5, len(flat)), replace=False):
            ends = []
            for step in (1e-5, -1e-5):
                flat[at] += step
                ends.append(quality.loss_and_gradient(model, x, begins, labels)[0])
                flat[at] -= step
            assert g.reshape(-1)[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7), name


def test_quality_score_by_a_plain_loop():
    rng = np.random.default_rng(2)
    bags = [rng.normal(0, 1, (rng.integers(1, 5), quality.N_FEATURES)) for _ in range(40)]
    model = quality.train(bags, rng.integers(0, 2, 40).astype(float), steps=20)
    w = model.weights
    for bag, got in zip(bags, model.score(bags), strict=True):
        hidden, strengths = [], []
        for row in bag:
            h = [np.tanh(sum((row[f] - model.mean[f]) / model.scale[f] * w["enc"][f, j] for f in range(len(row))) + w["enc0"][j]) for j in range(quality.HIDDEN)]
            gate = [np.tanh(np.dot(h, w["v"][:, j])) / (1 + np.exp(-np.dot(h, w["u"][:, j]))) for j in range(quality.GATE)]
            hidden.append(h)
            strengths.append(np.exp(np.dot(gate, w["a"])))
        mean = [sum(s * h[j] for s, h in zip(strengths, hidden, strict=True)) / sum(strengths) for j in range(quality.HIDDEN)]
        assert got == pytest.approx(1 / (1 + np.exp(-(np.dot(mean, w["out"]) + w["out0"][0]))))


def test_quality_learns():
    """The learned attention beats a constant, and passages' order does not matter."""
    rng = np.random.default_rng(0)
    bags = [rng.normal(0, 1, (rng.integers(1, 6), quality.N_FEATURES)) for _ in range(200)]
    labels = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    model = quality.train(bags, labels)
    assert np.mean((model.score(bags) >= 0.5) == labels) > 0.9
    assert model.score([b[::-1] for b in bags]) == pytest.approx(model.score(bags))


def test_rare_toxic_words_are_terms(spark):
    """Every word of an example is a term, however rare."""
    free = [k for k in range(3_000) if zlib.crc32(str(k).encode()) % 5][:2_400]
    rows = [(k, f"vermin name{k}" if at < 5 else f"idiot name{k}" if at < 400 else f"calm name{k}") for at, k in enumerate(free)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(k, int(at < 400)) for at, k in enumerate(free)], "doc_id long, toxic int"))
    assert len(index.words) == 3 + 2_400
    score, near = index.score("You vermin")
    assert score > 0.5 and len(near) == 5


def brute_toxicity(texts_of_docs, examples, queries, k=15):
    """Scores and neighbours from the definition, with dictionaries."""
    count = lambda t: Counter(re.findall(r"[a-z0-9]+", (t or "").lower()))
    df = Counter(w for t in texts_of_docs for w in count(t))
    distinct = {(t or "", y) for _, t, y in examples}
    sides = {y: [set(count(t)) for t, z in distinct if z == y] for y in (0, 1)}

    def strength(w):
        a, b = (sum(w in s for s in sides[y]) for y in (1, 0))
        n1, n0 = len(sides[1]), len(sides[0])
        table = [(a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b)]
        g = sum(2 * x * np.log(x * (n1 + n0) / (row * col)) for x, col, row in table if x)
        return np.log((1 + len(texts_of_docs)) / (1 + df[w])) * (g if g > 1e-9 else 0)

    known = {w: strength(w) for _, t, _ in examples for w in count(t)}

    def unit(t):
        v = {w: (1 + np.log(n)) * known[w] for w, n in count(t).items() if known.get(w, 0) > 0}
        z = sum(x * x for x in v.values()) ** 0.5
        return {w: x / z for w, x in v.items()}

    vectors = [(i, y, unit(t)) for i, t, y in examples]
    prior = (sum(y for _, _, y in examples) + 0.5) / (len(examples) + 1)
    for q in queries:
        v = unit(q)
        near = sorted(((-sum(x * u.get(w, 0) for w, x in v.items()), i, y) for i, y, u in vectors))
        near = [(-c, i, y) for c, i, y in near if round(-c, toxicity.DECIMALS) > 0][:k]
        votes = [1 / (1.1 - min(c, 1)) for c, _, _ in near]
        yield (sum(x * y for x, (_, _, y) in zip(votes, near, strict=True)) + 0.5 * prior) / (sum(votes) + 0.5), [c for c, _, _ in near]


def test_toxicity_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for k in range(700):
        words = sentence(rng, rng.randint(0, 60)).split() + [f"rare{rng.randint(0, 300)}" for _ in range(rng.randint(0, 5))]
        if k % 6 == 0:
            words += rng.choices(["idiot", "scum", "moron", "vermin"], k=rng.randint(1, 3))
        rows.append((k, " ".join(words)))
    rows += [(900 + k, t) for k, t in enumerate([None, "", rows[3][1], rows[3][1], "unknown words only", "Idiot! idiot? SCUM", "alpha"])]
    labels = [(k, int(k % 6 == 0)) for k in range(0, 700, 2)] + [(902, 0), (903, 1)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = dict(rows)
    examples = [(i, text[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    got = by_id(toxicity.toxicity_scores(docs, index))
    for (i, _), (score, cosines) in zip(rows, brute_toxicity(list(text.values()), examples, [t for _, t in rows]), strict=True):
        assert [e["cosine"] for e in got[i]["evidence"]] == pytest.approx(cosines, abs=1e-5), i
        # Single weights and ties at the last place may move a vote.
        assert got[i]["score"] == pytest.approx(score, abs=1e-4) or cosines[-1:] == pytest.approx(cosines[-2:-1], abs=1e-5), i


@pytest.mark.parametrize("slack", [0.0, 0.05, 0.5, 2.0])
def test_block_max_bounds_lose_nobody(monkeypatch, slack):
    monkeypatch.setattr(toxicity, "SLACK", slack)
    rng = np.random.default_rng(3)
    n, v = 3_000, 400
    rows = [np.sort(rng.choice(v, rng.integers(0, 12), replace=False)) for _ in range(n)]
    counts = [rng.integers(1, 4, len(r)) for r in rows]
    index = toxicity.build_index(np.arange(v, dtype=np.uint64), rng.uniform(0.5, 3, v), rng.permutation(n), rng.integers(0, 2, n), np.arange(n),
                                 np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), np.concatenate(counts))
    dense = np.zeros((n, v))
    for k in range(n):
        dense[k, index.row_terms[index.rows[k] : index.rows[k + 1]]] = index.row_weights[index.rows[k] : index.rows[k + 1]]
    for r, c in zip(rows[:300], counts[:300], strict=True):
        ts, ws = index.weigh(r, c)
        cosine = np.round(dense[:, ts] @ ws, toxicity.DECIMALS)
        order = np.lexsort((index.ids, -cosine))[: toxicity.NEIGHBOURS]
        assert [(pytest.approx(cosine[i], abs=2e-7), int(index.ids[i])) for i in order if cosine[i] > 0] == [(x, int(index.ids[i])) for x, i in index.nearest(ts, ws)]


def test_toxicity_is_calibrated(spark):
    """Held-out scores by bin agree with the share of label 1."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    index = toxicity.fit(docs, labels)
    held = toxicity.toxicity_scores(docs, index).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    score, truth = (np.array([r[k] for r in held], float) for k in range(2))
    bins = np.minimum((score * 5).astype(int), 4)
    off = sum((bins == b).mean() * abs(score[bins == b].mean() - truth[bins == b].mean()) for b in set(bins.tolist()))
    assert len(held) > 50 and off < 0.1
    assert ((score >= 0.5) == truth).mean() > 0.9


def test_toxicity_examples_come_in_parts(spark, monkeypatch):
    """The driver's JVM never collects the examples' words as one result."""
    docs = spark.createDataFrame([(k, f"word{k % 7} calm {'vile' if k % 3 == 0 else 'kind'}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    kind, plain = type(docs), type(docs).toArrow

    def watched(self, *args, **kwargs):
        assert "words" not in self.columns
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(kind, "toArrow", watched)
    index = toxicity.fit(docs, labels)
    assert index.score("vile")[0] > 0.5 > index.score("kind")[0]


def test_decontamination_joins_texts_alike_at_any_size(spark, monkeypatch):
    """Small tables shuffle texts as large ones do, so what is moved grows with the input."""
    plans, plain = {}, decontaminate.materialise

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(decontaminate, "materialise", watched)
    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"before it {text} and after"), (2, "nothing of it at all here")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(9, text)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in got] == [(1, 9, 1.0)]
    assert plans["windows"].count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plans["windows"]


def test_signs_stand_alone_and_marks_are_kept_apart():
    """Words with signs behind them are one word each; ids are the library's."""
    coder = token_files.WordIds(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    assert coder.wordwise and coder.words(b"calm$$$ Calm.%%% calm") == [b"calm", b"$$$", b"calm", b".%%%", b"calm"]
    texts = ["a\x01b \x01 c\x01", "\x01", "it's.'s x'$ y$'t (1)$$ $$z", "calm$$$ calm.%%%\tvile,***\n_x_ x_", "é$$ é$$ <x>$ z", "w" * 99 + "## w", ""]
    for again in range(2):
        assert [b"".join(p) for p in coder.batch(texts)] == [coder.whole(t) for t in texts]
