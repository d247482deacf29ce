from itertools import combinations

from markwise.llm import names, queries

SCHEMA = "student_ref string, class_id string, student_name string, ref string, parts string"


def pairs(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {tuple(r) for r in names.same_student(names.students(frame)).collect()}


def test_folded():
    fold = names.folded
    assert fold("Kemadale, Angelika") == fold("ANGELIKA\tKEMADALE") == ("angelika", "kemadale")
    assert fold("Bjoern Gelamardo") == fold("Bjørn_Gelamardo") == fold("Björn  Gelamardo")
    assert fold("李 悦　琪同学") == fold("李悦琪(补)") == ("李悦琪",) and fold(" .,- ") == ()


def test_names_alike():
    alike = lambda a, b: names.names_alike(names.folded(a), names.folded(b), {"geli": ("angelika",), "angelika": ("geli",)})
    for a, b in [("A. Kemadale", "Angelika Kemadale"), ("Geli Kemadale", "Kemadale Angelika"), ("Angelika Keamdale", "Angelika Kemadale"), ("R S. Bororston", "Rowena Sofía Bororstno"), ("Néstor Krebómbe", "Krebómbe Néstor Priyanka")]:
        assert alike(a, b) >= names.LINKED, (a, b)
    for a, b in [("Anton Kemadale", "Angelika Kemadale"), ("B. Kemadale", "Angelika Kemadale"), ("Angelika Valdori", "Angelika Kemadale"), ("Priyanka Krebómbe", "Néstor Priyanka Krebómbe"), ("Rowena Sofía Bororston", "Rowena Maria Bororston"), ("Angelika", "Angelika Kemadale")]:
        assert alike(a, b) < names.LINKED, (a, b)


def test_slips():
    for a, b, n in [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abcd", "badc", 2), ("abc", "xyz", 3), ("", "abcd", 3)]:
        assert names.slips(a, b) == names.slips(b, a) == n


def test_students_of_classes(spark):
    rows = [
        ("s1", "c", "Angelika Kemadale"), ("s2", "c", "Geli Kemadale"), ("s2", "c", "Angelika  KEMADALE"), ("s3", "c", "Kemadale, A."), ("s4", "c", "Anton Bruzefeld"), ("s5", "c", "Berta Bruzefeld"), ("s6", "d", "Angelika Kemadale"),
        ("s7", None, "Angelika Kemadale"), ("s8", "c", None), ("s8", "", "Angelika Kemdale"), ("s9", "c", "李悦琪"), ("s10", "c", "李 月 琪"), ("s11", "c", "李月琪"), ("s11", "c", "李悦琪"), (None, "c", "Angelika Kemadale"), ("s1", "c", "Angelika Kemadale"),
    ]
    got = pairs(spark, rows)
    assert got == {*combinations(["s1", "s2", "s3", "s8"], 2), *map(lambda p: tuple(sorted(p)), combinations(["s9", "s10", "s11"], 2))}
    assert pairs(spark, []) == set() and pairs(spark, [("s1", "c", None)]) == set()


def test_characters_that_no_ref_carries_both_of(spark):
    rows = [
        ("s1", "c", "谢择凡"), ("s2", "c", "謝泽帆"), ("s3", "c", "谢月华"), ("s4", "c", "谢月琪"), ("s5", "d", "谢择凡"), ("s6", "c", "吕凡"), ("s7", "c", "路凡"),
        ("t1", "e", "孙小末"), ("t1", "e", "孙小未"), ("t2", "e", "孙小末"), ("t3", "e", "孙小未"),
    ]
    assert pairs(spark, rows) == {("s1", "s2"), *combinations(["t1", "t2", "t3"], 2)}


def test_characters_alike():
    sounds = {"谢择凡": ("谢择凡",), "謝泽帆": ("谢择凡",)}
    assert names.names_alike(("谢择凡",), ("謝泽帆",), sounds) == names.SAME_SOUND >= names.LINKED
    assert 0 < names.names_alike(("谢择凡",), ("谢择文",), sounds) < names.LINKED
    assert names.names_alike(("谢择凡",), ("谢月文",), sounds) == names.names_alike(("谢择",), ("谢文",), sounds) == 0


def test_average_linkage_against_one_merge_at_a_time(spark):
    import random

    rng = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(24)]
    sims = {p: round(rng.uniform(0.3, 1.0), 3) for p in combinations(nodes, 2) if rng.random() < 0.25}
    groups = [{n} for n in nodes]

    def mean(a, b):
        return sum(sims.get(tuple(sorted((x, y))), 0) for x in a for y in b) / (len(a) * len(b))

    while True:
        best = max(((mean(a, b), a, b) for a, b in combinations(groups, 2)), key=lambda x: x[0])
        if best[0] < names.LINKED:
            break
        groups = [g for g in groups if g not in best[1:]] + [best[1] | best[2]]
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a string, b string, alike double")
    got = {}
    for r in names.clustered(edges).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups if len(g) > 1)
    assert all(c == min(g) for c, g in got.items())


def test_join_finds_every_pair_of_the_cosine(spark, data):
    heads, _ = names.nodes(names.spellings(spark.read.parquet(f"{data}/attempts.parquet")))
    weights = names.gram_weights(heads)
    rows = heads.collect()
    short = {r["node"]: {k: tuple(v) for k, v in (r["others"] or {}).items()} for r in rows}
    want = set()
    for x, y in combinations(sorted(rows, key=lambda r: r["node"]), 2):
        if x["block"] == y["block"]:
            near = lambda s, t: names.cosine_of(names.vector(s, weights), names.vector(t, weights)) >= names.COSINE
            if any(names.names_alike(tuple(a), tuple(b), short[x["node"]] | short[y["node"]], near) > 0 for a in x["forms"] for b in y["forms"]):
                want.add((x["node"], y["node"]))
    assert {(r["a"], r["b"]) for r in names.links(heads).collect()} == want


def test_query(spark, data):
    found = queries.p3_found(spark, data).collect()
    assert found and all(r["ref_a"] < r["ref_b"] for r in found) and len(set(found)) == len(found)
    assert queries.p3_students(spark, data).count() > len(found)


def test_linkage_in_memory_equals_the_distributed_rounds(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = [(f"k{k}", f"k{k}n{i:02d}", f"k{k}n{j:02d}", round(rng.uniform(0.3, 1.0), 2)) for k in range(6) for i, j in combinations(range(14), 2) if rng.random() < 0.3]
    edges = spark.createDataFrame(rows, "block string, a string, b string, alike double")
    few = {tuple(r) for r in names.clustered_in_blocks(edges).collect()}
    monkeypatch.setattr(names, "MANY_LINKS", 25)
    assert {tuple(r) for r in names.clustered_in_blocks(edges).collect()} == few == {tuple(r) for r in names.clustered(edges.drop("block")).collect()}


def test_large_blocks_and_heavy_keys_give_the_same(spark, data, monkeypatch):
    heads, _ = names.nodes(names.spellings(spark.read.parquet(f"{data}/attempts.parquet")))
    rounded = lambda: {(*tuple(r)[:3], round(r["alike"], 9)) for r in names.links(heads).collect()}
    want = rounded()
    monkeypatch.setattr(names, "MANY_NAMES", 2)
    monkeypatch.setattr(names, "HEAVY", 3)
    assert rounded() == want


def test_one_wrong_name_teaches_nothing_about_a_frequent_one(spark):
    rows = [(f"s{i}", "c", n) for i in range(60) for n in ("Geli Kemadale", "Angelika Kemadale")] + [("t", "c", "Geli Kemadale"), ("t", "c", "Anton Kemadale"), ("u", "c", "Anton Kemadale"), ("u", "c", "Toni Kemadale")]
    found = names.short_forms(names.spellings(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)))
    assert {r["part"]: r["others"] for r in found.where("part in ('geli', 'toni')").collect()} == {"geli": ["angelika"], "toni": ["anton"]}
