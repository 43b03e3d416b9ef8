import hashlib
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, docs, odd_docs, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, repeats, simhash
from tessera.llm.common import components, shared_dir, shrink


def test_directory_doubles_and_splits():
    assert exact_dedup.extendible_directory({}, 4, 8) == (0, [0])
    depth, buckets = exact_dedup.extendible_directory({0: 3, 1: 3, 255: 1}, 4, 8)
    assert depth == 8 and buckets[0] != buckets[1] and len(set(buckets[2:])) == 7  # prefixes 0 and 1 had to part
    depth, buckets = exact_dedup.extendible_directory({7: 100}, 4, 3)  # one key range can't be split beyond the depth
    assert depth == 3 and len(buckets) == 8


@pytest.mark.parametrize("key,capacity", [(None, 1), (None, 4096), ("length", 1), ("one", 2)])
def test_exact_groups(spark, key, capacity):
    source = odd_docs(spark)
    forced = {None: None, "length": F.shiftleft(F.pmod(F.length("text"), F.lit(8)).cast("long"), 58), "one": F.lit(5).cast("long")}[key]
    found = exact_dedup.exact_groups(source, capacity, 6, forced)
    rows = [(r["doc_id"], r["text"] or "") for r in source.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found.collect()), key=repr)
    want = sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    assert got == want
    assert found.where("kept").count() == len(groups)
    assert found.select("bucket", "slot", "text_sha256").distinct().count() == len(groups)


def test_hot_copies(spark):
    rows = [(i, "same") for i in range(3000)] + [(i + 5000, f"t{i}") for i in range(3000)]
    found = exact_dedup.exact_groups(docs(spark, rows), capacity=64)
    assert found.count() == 6000 and table(found.where("kept AND group_size > 1").select("doc_id", "group_size")) == [(2999, 3000)]


INSIDE = (
    "_text _key _given _id _tid _row text_sha256 key carry top bucket group_size given others row tid sid n root first keys counts least chunk owner kept first_doc n_bytes "
    "n_removed part turn slot keep_id kind a b m signature place fingerprint component_id node low size"
).split()


def clashing(spark, rows):
    """Documents with a column for each name that operators use inside; their values tell the rows apart."""
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in INSIDE)
    return spark.createDataFrame([(i, t, len(t or ""), *(f"{c} of {i}" for c in INSIDE)) for i, t in rows], schema)


def values_kept(source, found):
    """Whether all rows of ``found`` have their own document's values in all columns but the text and its length."""
    names = [c for c in source.columns if c not in ("text", "n_chars")]
    own = {tuple(r) for r in source.select(*[f"`{c}`" for c in names]).collect()}
    rows = [tuple(r) for r in found.select(*[f"`{c}`" for c in names]).collect()]
    return found.columns == source.columns and found.schema["text"].dataType == source.schema["text"].dataType and len(rows) == len(set(rows)) and set(rows) <= own


@pytest.mark.parametrize("operator", [exact_dedup.deduplicate, simhash.near_dedup, repeats.strip_repeats])
def test_columns_of_any_name_keep_their_values(spark, operator):
    rows = [(1, LONG), (2, LONG + "x y"), (3, LONG), (4, ""), (5, None), (6, "short"), (7, "other words " * 30)]
    source = clashing(spark, rows)
    found = operator(source)
    assert values_kept(source, found)
    want = {"deduplicate": {2, 3, 5, 6, 7}, "near_dedup": {1, 4, 6, 7}, "strip_repeats": {1, 2, 3, 4, 5, 6, 7}}[operator.__name__]
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == want
    texts = {r["doc_id"]: r["text"] for r in found.select("doc_id", "text").collect()}
    if operator is not repeats.strip_repeats:
        assert all(texts[i] == t for i, t in rows if i in texts)
    else:
        assert texts[1] == LONG and texts[3] == "" and texts[5] is None and texts[6] == "short" and len(texts[2]) < 60
    assert operator(source.limit(0)).count() == 0


def test_repeated_rows_of_one_id(spark):
    """Of rows equal in doc_id and text one stays, also if there are many in many partitions."""
    rows = [(None, "the same words in every row")] * 500 + [(3, "another text altogether")] * 20 + [(4, "alone")]
    source = docs(spark, rows).repartition(7)
    groups = exact_dedup.exact_groups(source)
    assert groups.count() == 521 and table(groups.where("kept").select("doc_id", "group_size")) == sorted([(None, 500), (3, 20), (4, 1)], key=repr)
    for operator in (exact_dedup.deduplicate, simhash.near_dedup):
        assert table(operator(source).select("doc_id")) == sorted([(None,), (3,), (4,)], key=repr)


def test_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        shared_dir(Cluster)


def test_deduplicate_keeps_columns(spark):
    source = odd_docs(spark)
    found = exact_dedup.deduplicate(source)
    assert found.columns == source.columns and found.count() == len({r["text"] or "" for r in source.collect()})
    assert {r["doc_id"] for r in found.where(F.col("text") == LONG).collect()} == {5}
    assert exact_dedup.deduplicate(source.limit(0)).count() == 0


def brute_simhash(rows, words, distance):
    from xxhash import xxh64_intdigest

    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    return prints


def brute_components(prints, distance):
    n = len(prints)
    seen, of = set(), [None] * n
    for i in range(n):
        if i in seen:
            continue
        todo, seen = [i], seen | {i}
        while todo:
            x = todo.pop()
            of[x] = i
            for y in range(n):
                if y not in seen and bin(prints[x] ^ prints[y]).count("1") <= distance:
                    seen.add(y)
                    todo.append(y)
    return of


def as_unsigned(v):
    return v % 2**64


def test_near_groups_of_odd_rows(spark):
    source = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in source.collect()]
    prints = brute_simhash(rows, 4, 4)
    of = brute_components(prints, 4)
    least = {c: min((rows[i][0] for i in range(len(rows)) if of[i] == c and rows[i][0] is not None), default=None) for c in set(of)}
    got = sorted(((r["doc_id"], as_unsigned(r["fingerprint"]), r["component_id"]) for r in simhash.near_groups(source, 4, 4).collect()), key=repr)
    assert got == sorted(((rows[i][0], prints[i], least[of[i]]) for i in range(len(rows))), key=repr)
    assert simhash.near_groups(source.limit(0), 4, 4).count() == 0


def test_near_groups_of_one_text_in_a_third_of_all_rows(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(words)) for i in range(300, 600)]
    rows += [(i, " ".join(words[:i] + ["changed"] + words[i + 1 :])) for i in range(0, 300, 2)]  # near it
    rows += [(1000 + i, " ".join(f"u{i}.{k}" for k in range(20))) for i in range(300)] + [(2000 + i, None) for i in range(150)]
    prints = brute_simhash(rows, 4, 4)
    of = brute_components(prints, 4)
    least = {c: min(rows[i][0] for i in range(len(rows)) if of[i] == c) for c in set(of)}
    found = simhash.near_groups(docs(spark, rows).repartition(7), 4, 4).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((r[0], as_unsigned(r[1]), r[2]) for r in found) == sorted((rows[i][0], prints[i], least[of[i]]) for i in range(len(rows)))
    assert sum(r[2] == 2000 for r in found) >= 150 and sum(c == of[0] for c in of) > 400


@pytest.mark.parametrize("distance", [4, 7])
def test_links_connect_what_is_near(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 8), replace=False)) for b in base for _ in range(25)]
    prints = sorted({*near, *map(int, rng.integers(0, 2**63, 200, dtype=np.uint64))})
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint long")
    found = {r["node"]: r["root"] for r in components(simhash.links(simhash.signatures(frame, distance), distance)).collect()}
    of = brute_components(prints, distance)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    groups, mine = defaultdict(set), defaultdict(set)
    for i, p in enumerate(signed):
        groups[of[i]].add(p)
        mine[found.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_forest_splits_large_groups():
    rng = np.random.default_rng(0)
    center = np.uint64(rng.integers(0, 2**62))
    group = np.unique(np.array([center ^ np.uint64(sum(1 << int(k) for k in rng.choice(40, 3, replace=False))) for _ in range(400)], np.uint64))
    whole, split = (simhash.forest(group, 4, simhash.free_blocks(128, 4), most) for most in (10**9, 10))
    for found in (whole, split):
        assert all((np.bitwise_count(a ^ b) <= 4).all() for a, b in found)
    join = lambda f: brute_labels(group, f)
    assert join(whole) == join(split)


def brute_labels(group, found):
    from tessera.llm.common import Forest

    f = Forest()
    for a, b in found:
        f.add(a.astype(np.int64).tolist(), b.astype(np.int64).tolist())
    return [f.root(int(x)) for x in group.astype(np.int64)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7).mapInArrow(shrink, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and all(found[1000 + i] == 1000 for i in range(1, 40))


def test_near_dedup(spark):
    words = [f"w{i}" for i in range(200)]
    near = [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in (20, 90, 160)]
    half = " ".join(words[:100] + [f"v{i}" for i in range(100)])
    source = docs(spark, [(4, " ".join(words)), (2, near[0]), (9, near[1]), (8, near[2]), (1, half), (7, "short one"), (6, None), (5, "")])
    assert sorted(r["doc_id"] for r in simhash.near_dedup(source).collect()) == [1, 2, 5, 7]
    assert simhash.near_dedup(source.limit(0)).count() == 0


def brute_repeats(rows, least):
    first: dict[bytes, int] = {}
    rank = lambda i: 2**63 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - least + 1):
            key = b[s : s + least]
            first[key] = min(rank(i), first.get(key, 2**63))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = [False] * len(b)
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < rank(i):
                cut[s : s + least] = [True] * least
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = sum(c and (k == 0 or not cut[k - 1]) for k, c in enumerate(cut))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 20])
def test_removed_bytes_of_odd_rows(spark, chunk_bytes):
    source = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in source.collect()]
    assert table(repeats.removed_bytes(source, 50, chunk_bytes)) == brute_repeats(rows, 50)
    assert repeats.removed_bytes(source.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_removed_bytes_of_random_overlaps(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abcé"), 130)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.integers(1, 5)):
            p = pool[rng.integers(6)]
            a = rng.integers(0, 70)
            parts.append(p[a : a + rng.integers(20, 90)] + "".join(rng.choice(list("xyz"), rng.integers(0, 4))))
        rows.append((int(i), "".join(parts)))
    assert table(repeats.removed_bytes(docs(spark, rows), 50, 700)) == brute_repeats(rows, 50)


def test_removed_bytes_of_a_passage_in_many_surroundings(spark):
    """A third of all documents hold one passage, each among its own words, some of them cut short."""
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh"), 90))
    own = lambda: "".join(rng.choice(list("uvwxyz "), 40))
    rows = [(i, own() + (passage[i % 7 : 90 - i % 5] if i % 3 == 0 else "") + own()) for i in range(600)]
    assert table(repeats.removed_bytes(docs(spark, rows), 50, 4096)) == brute_repeats(rows, 50)


def test_strip_repeats_keeps_whole_characters(spark):
    shared = "é" * 40  # 80 bytes
    rows = [(1, "a" + shared, "x", 5), (2, "b" + shared + "c", "y", 6), (3, None, "z", 0), (4, "b" + shared + "c", "w", 6)]
    found = repeats.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"))
    assert table(found) == [(1, "a" + shared, "x", 41), (2, "bc", "y", 2), (3, None, "z", None), (4, "", "w", 0)]


def brute_maximal(texts, least):
    found = set()
    subs = defaultdict(set)
    for t, text in enumerate(texts):
        for p in range(len(text)):
            for n in range(least, len(text) - p + 1):
                subs[text[p : p + n]].add((t, p))
    for s, places in subs.items():
        if len(places) < 2:
            continue
        left = {texts[t][p - 1] if p else (-1, t) for t, p in places}
        right = {texts[t][p + len(s)] if p + len(s) < len(texts[t]) else (-1, t, p) for t, p in places}
        if len(left) > 1 and len(right) > 1:
            found.add((len(s), tuple(sorted(places))))
    return found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=4))
def test_maximal_repeats(texts):
    coded = [t.encode() for t in texts]
    assert {(n, tuple(sorted(p))) for n, p in repeats.maximal_repeats(coded, 2)} == brute_maximal(coded, 2)


def kept(spark, texts, parts=8):
    return {r["doc_id"] for r in simhash.near_dedup(docs(spark, list(enumerate(texts))).repartition(parts)).select("doc_id").collect()}


def least_of_groups(texts, least=0.8):
    """By brute force: the smallest position of each group that similar shingle sets link."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    of = list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in at[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if n >= least * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return {root(i) for i in range(len(texts))}


def test_near_dedup_among_texts_that_share_text(spark):
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(30)]
    texts = []
    for i in range(1500):  # half of each text is common, so fingerprints of strangers are near
        own = [f"u{i}.{k}" for k in range(30)]
        texts.append(" ".join(common + own))
        if i % 10 == 0:
            own[int(rng.integers(5, 25))] = "changed"
            texts.append(" ".join(common + own))
    want = least_of_groups(texts)
    assert len(texts) - len(want) == 150 and kept(spark, texts) == want


def test_near_dedup_finds_all_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(400):  # one run of changed words: similarity from 0.8 up, and just below it
        words = [f"u{i}.{k}" for k in range(240)]
        texts.append(" ".join(words))
        n = int(rng.integers(15, 26))
        words[100 : 100 + n] = [f"v{i}.{k}" for k in range(n)]
        texts.append(" ".join(words))
    want = least_of_groups(texts)
    assert 400 < len(want) < 700 and kept(spark, texts) == want


def test_near_dedup_ignores_how_often_shingles_repeat(spark):
    line = " ".join(f"l{k}" for k in range(11))
    own = " ".join(f"u{k}" for k in range(200))
    texts = [f"{own} {line} {line}", f"{own} " + " ".join([line] * 300)]
    assert kept(spark, texts) == least_of_groups(texts) == {0}


def test_near_dedup_checks_texts_of_equal_fingerprints(spark):
    line = " ".join(f"l{k}" for k in range(11))
    texts = [" ".join([line] * 200 + [f"{name}{k}" for k in range(100)]) for name in "ab"]
    texts.append(texts[1].replace("b50", "changed"))  # near the second, not the first
    assert len({simhash.fingerprint(t, 5) for t in texts}) == 1
    assert kept(spark, texts) == least_of_groups(texts) == {0, 1}


def test_columns_that_have_no_order(spark):
    """Maps can't be compared; the rows that stay are told apart by the other columns, then by the map as text."""
    rows = [(1, "the same words again and again here", {"a": 1}, 5), (1, "the same words again and again here", {"b": 2}, 5), (1, "the same words again and again here", {"z": 2}, 4), (2, "other words that stand alone in this row", None, None), (None, None, {}, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, rank int").repartition(3)
    want = [r for r in rows if r[2] not in ({"a": 1}, {"z": 2})]
    for kept in (exact_dedup.deduplicate(df), simhash.near_dedup(df)):
        assert kept.columns == df.columns and sorted((tuple(r) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert repeats.strip_repeats(df, least=50).count() == 5


@pytest.mark.parametrize("least", [0, 23, 129, 300])
def test_lengths_that_repeats_cannot_have(spark, least):
    with pytest.raises(ValueError, match="least must be"):
        repeats.removed_bytes(docs(spark, [(1, "a")]), least=least)


def test_repeats_of_the_longest_length(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    found = {r["doc_id"]: r["n_removed"] for r in repeats.removed_bytes(docs(spark, [(1, text), (2, "x" + text[100:228] + "y"), (3, "w" + text[100:227] + "v")]), least=128).collect()}
    assert found == {1: 0, 2: 128, 3: 0}


def test_near_dedup_compares_what_signatures_find(spark, monkeypatch):
    """Without any shared band, fingerprints within 4 bits are still compared, each pair by its own sets."""
    from xxhash import xxh64_intdigest as digest

    monkeypatch.setattr(simhash, "band_keys", lambda s: (np.uint64(digest(s.tobytes(), 3)) + np.arange(24, dtype=np.uint64)).view(np.int64))
    words = [f"w{i}" for i in range(600)]
    near = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in (100, 200, 300)]
    line = " ".join(f"line{i}" for i in range(11)) + " "
    others = [line * 200 + " ".join(f"{x}{i}" for i in range(120)) for x in "ab"]  # equal fingerprints, but different sets
    texts = [" ".join(words), *near, *others, others[1].replace("b50", "changed")]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert max((prints[0] ^ p).bit_count() for p in prints[1:4]) <= 4 and len(set(prints[4:])) == 1
    assert kept(spark, texts) == {0, 4, 5}


def test_removing_takes_few_bytes_a_byte_of_a_chunk():
    text = np.random.default_rng(3).integers(97, 123, 4 << 20, np.uint8).tobytes()
    rows, none = pa.table({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text], pa.binary())}), repeats.table_of(repeats.COVERED, [])
    tracemalloc.start()
    found = repeats._remove(50, True)((pa.scalar(0),), rows, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["kept"].to_pylist() == [text] and peak < 9 * len(text)


def test_snippets_are_answered_by_parts():
    rng = np.random.default_rng(4)
    passages = [rng.integers(97, 123, 200, np.uint8).tobytes() for _ in range(40)]
    rows = [(i, b"".join(rng.integers(97, 123, 30, np.uint8).tobytes() + passages[k][: rng.integers(40, 200)] for k in rng.integers(0, 40, 5))) for i in range(200)]
    chunk = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.binary())})
    key = (pa.scalar(0),)
    sent = repeats._send_snippets(50, 1)(key, chunk, repeats._answer_tags(key, repeats._send_tags(50, 1)(key, chunk)))
    one, many = (repeats._remove(50, False)(key, chunk, repeats._answer_snippets(50, n)(key, sent)).to_pylist() for n in (1 << 30, 1 << 14))
    assert one == many and sum(r["n_removed"] for r in one) > 1000
