"""Near-dedup (7), its components, and substring dedup (10)."""

import hashlib
import random

from pyspark.sql import functions as F

from procure_spark.llm import op07_neardup as near
from procure_spark.llm import op10_suffixes as sub
from procure_spark.llm.graph import components


def brute_near(rows, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def make(rng):
    rows, at = [], 0
    for _ in range(12):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.randrange(1, 14)):
            rows.append((at, edited(rng, base, rng.randrange(0, 4))))
            at += 1
    return rows + [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one Two"), (at + 4, "ONE two"), (at + 5, "É two"), (at + 6, "é two")]


def test_near_duplicates_equal_brute_force(spark):
    rows = make(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(4)
    got = near.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near.drop_near_duplicates(df, 80, 12)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_near(rows, 80)}
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_large_keys_are_compared_block_by_block(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3, 6, 9]))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near.in_blocks, "__defaults__", (8,))
    got = near.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows)


def test_blocks_hold_every_pair_of_labels_once(spark):
    rng = random.Random(16)
    rows = [(k, bytes([k, i]), bytes([label])) for k, sizes in ((1, [20, 9, 1, 1, 2]), (2, [3, 2]), (3, [12, 12])) for label, n in enumerate(sizes) for i in range(label * 40, label * 40 + n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, class binary, label binary").withColumns({"slot": F.lit(0), "sig": F.lit(b""), "long": F.lit(b""), "n": F.lit(1)})
    units = {}
    for r in near.in_blocks(df, 8).collect():
        units.setdefault(r["unit"], []).append((r["side"], bytes(r["class"]), bytes(r["label"])))
    seen = {}
    for held in units.values():
        assert len(held) <= 60 and {s for s, _, _ in held} in ({0, 1}, {-1})
        assert len({label for _, _, label in held}) > 1 or all(s == -1 for s, _, _ in held)
        for s, a, la in held:
            for t, b, lb in held:
                if la != lb and a < b and ({s, t} == {0, 1} or s == -1):
                    seen[a, b] = seen.get((a, b), 0) + 1
    assert seen == {(a, b): 1 for k, a, la in rows for j, b, lb in rows if k == j and a < b and la != lb}


def test_ids_that_many_texts_share(spark):
    rng = random.Random(17)
    rows = [(None, " ".join(f"t{rng.randrange(10**6)}" for _ in range(30))) for _ in range(40)]
    rows += [(None, text + " more") for _, text in rows[:10]]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 50 and all(r["component_id"] is None and r["kept"] for r in got)
    kept = near.drop_near_duplicates(spark.createDataFrame([(5, text) for _, text in rows[:10]] + [(4, text + " more") for _, text in rows[:10]], "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {4}


def test_copies_go_where_an_id_has_other_texts(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    rows = [(5, texts["c"]), (6, texts["c"] + " x"), (6, texts["d"]), (1, texts["a"]), (None, texts["a"] + " x"), (None, texts["b"]), (None, None), (6, ""), (8, texts["c"]), (8, texts["c"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = near.drop_near_duplicates(df, 80, 12)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, texts["c"]), (6, texts["d"]), (1, texts["a"]), (None, texts["b"]), (None, None), (6, "")], key=str)
    one_id = spark.createDataFrame([(7, texts["a"]), (7, texts["a"] + " x"), (7, texts["b"])], "doc_id long, text string")
    left = [r["text"] for r in near.drop_near_duplicates(one_id).collect()]
    assert len(left) == 2 and texts["b"] in left


def test_repeated_and_null_ids(spark):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other words here"), (None, text), (None, "alone")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (1, 1, True), (None, 1, False), (None, None, True)], key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(300, 300)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label if any(x in e and e[0] != e[1] for e in edges)}


def brute_sub(rows, n=100):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - n + 1):
            if data[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(data[p : p + n])
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


def passages(rng):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([rng.choice(shared), word(), shared[0][: rng.randrange(200)]]) for _ in range(rng.randrange(6)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "x" * 5000), (103, "x" * 99), (104, "ab" * 400), (105, rows[3][1]), (106, rows[3][1]), (107, "x" * 101)]


def test_substring_dedup_equals_brute_force(spark):
    rows = passages(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash")).repartition(5)
    got = sub.dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect()
    assert sorted(map(tuple, got)) == brute_sub(rows)
    assert sub.dedup_substrings(df.limit(0)).count() == 0


def test_groups_are_sorted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sub, "PART", 3)
    rng = random.Random(5)
    text = " ".join(str(rng.random()) for _ in range(30))
    rows = [(i, f"{rng.random()} {text[rng.randrange(9):]} {rng.random()}") for i in range(40)]
    got = sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect()
    assert sorted(map(tuple, got)) == brute_sub(rows)


def test_long_texts_are_treated_in_pieces(monkeypatch):
    monkeypatch.setattr(sub, "_PIECE", 500)
    data = bytes(random.Random(6).choices(b"abc", k=3000))
    h, _, at, first, last = sub.anchors(data)
    covered = [p for f, l in zip(first, last, strict=True) for p in range(f, l + 1)]
    assert covered == list(range(len(data) - sub.LENGTH + 1)) and all(0 <= a - f and a + sub.GRAM <= l + sub.LENGTH and l - f < 128 for a, f, l in zip(at, first, last, strict=True))


def test_repeated_and_null_ids_of_substrings(spark):
    text = " ".join(str(i) for i in range(80))
    rows = [(1, text), (1, text), (1, "y" + text), (None, text), (2, text)]
    got = sorted(((r["doc_id"], r["n_removed"] > 0) for r in sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, True), (1, True), (1, True), (None, False), (2, True)], key=str)


def test_hot_anchors_change_no_result(spark, monkeypatch):
    rng = random.Random(15)
    passage = " ".join(str(rng.random()) for _ in range(20))
    rows = passages(rng) + [(1000 + i, f"{rng.random()} {passage} {rng.random()}" if i % 3 else passage) for i in range(150)] + [(1001, f"{rng.random()} {passage}")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = brute_sub([(d, t) for d, t in dict.fromkeys(rows) if d != 1001])
    results = []
    for sampled, count in ((64, 10**9), (1, 1), (1, 20)):
        monkeypatch.setattr(sub, "HOT", 10**6)
        monkeypatch.setattr(sub, "SAMPLED", sampled)
        monkeypatch.setattr(sub, "HOT_COUNT", count)
        monkeypatch.setattr(sub, "SALTS", 7)
        hot = sub.hottest(df.select(F.col("doc_id").alias("doc"), "text"))
        assert bool(hot) == (count < 10**9) and len(hot) <= sub.HOT
        results.append(sorted(map(tuple, sub.dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect())))
    assert results[0] == results[1] == results[2]
    assert [r for r in results[0] if r[0] < 1000] == [r for r in once if r[0] < 1000]


def test_no_unit_grows_with_a_passage(spark, monkeypatch):
    monkeypatch.setattr(sub, "PART", 8)
    rng = random.Random(8)
    passage = " ".join(str(rng.random()) for _ in range(12))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(400)] + [(1000, f"{passage} end")] * 100
    assert sub.rounds(500) == [8, 64, 512]
    copies, sort = [], sub.sorted_units

    def counted(contexts, hand_on):
        # Contexts of a unit in the first round; copies of one string in the later ones.
        kind = contexts.withColumn("string", F.when(F.col("place").bitwiseAND(127) == 0, F.col("context")))
        copies.append(kind.groupBy("unit", "string").count().agg(F.max("count")).first()[0] or 0)
        return sort(contexts, hand_on)

    monkeypatch.setattr(sub, "sorted_units", counted)
    got = sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect()
    once = brute_sub(list(dict.fromkeys(rows)))
    assert sorted(map(tuple, got)) == sorted(x for d, *_ in rows for x in once if x[0] == d)
    assert len(copies) == 4 and max(copies) <= 8 * 4


def test_equal_rows_count_as_one(spark):
    text, passage = " ".join(str(i) for i in range(80)), " ".join(f"p{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, "a " + passage), (3, passage + " b"), (3, passage + " b"), (4, "c" * 400), (4, "c" * 400)]
    got = [tuple(r) for r in sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect()]
    once = brute_sub(list(dict.fromkeys(rows)))
    assert sorted(got) == sorted(x for d, *_ in rows for x in once if x[0] == d)
    assert [r[2] for r in got if r[0] == 1] == [0, 0]


def test_multikey_quicksort_finds_all_ties():
    rng = random.Random(9)
    for n, letters in ((0, b"ab"), (1, b"ab"), (400, b"ab"), (3000, b"abcd"), (300, b"a")):
        data = bytes(rng.choices(letters, k=n + 40))
        starts = [rng.randrange(n + 1) for _ in range(n)]
        wanted = {}
        for i, at in enumerate(starts):
            wanted.setdefault(data[at : at + 24], set()).add(i)
        got = [set(g.tolist()) for g in sub.multikey_ties(data, sub.np.array(starts, sub.np.int64), 24)]
        assert sorted(map(sorted, got)) == sorted(sorted(x) for x in wanted.values() if len(x) > 1)


def test_null_ids_lose_their_own_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, f"{passage} | {passage}"), (3, f"a {passage} b"), (None, None)]
    got = {(r["doc_id"], r["n_bytes"]): r for r in sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = {(d if d >= 0 else None, n): (gone, spans) for d, n, gone, spans, _ in brute_sub([(-1, rows[0][1]), (3, rows[1][1]), (-2, None)])}
    assert {k: (r["n_removed"], r["n_spans"]) for k, r in got.items()} == wanted


def test_unique_texts_of_a_shared_id_lose_nothing(spark):
    # Many texts under one id, and under none: only those with the passage lose it, and all but one do.
    passage = " ".join(f"p{i}" for i in range(60))
    for doc in (7, None):
        rows = [(1, f"0 {passage} end")] + [(doc, f"{i} {passage} {i * 7}") for i in range(300)] + [(doc, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(1500)]
        got = sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", F.decode("kept_bytes", "UTF-8").alias("kept")).collect()
        lost = [r for r in got if r["n_removed"]]
        assert len(got) == len(rows) and len(lost) == 300
        kept = {r["kept"] for r in got}
        assert all(text in kept for _, text in rows[301:])


def test_substring_query(spark, tmp_path):
    rows = passages(random.Random(11))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = sub.op10_deep_shallow_dedup(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert sorted(map(tuple, got.collect())) == brute_sub(rows)


def test_near_duplicate_query(spark, tmp_path):
    rows = make(random.Random(12)) + [(9000, "long " * 30_000), (9001, "long " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = near.op7_hamming_neardup(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_near(rows)


def test_blind_tries_group_and_order():
    rng = random.Random(7)
    strings = [bytes(rng.choices(b"ab", k=8)) for _ in range(300)]
    groups = sub.blind_trie(strings, list(range(300)))
    assert sorted(i for g in groups for i in g) == list(range(300)) and all(len({strings[i] for i in g}) == 1 for g in groups)
    assert [strings[g[0]] for g in groups] == sorted(set(strings))
