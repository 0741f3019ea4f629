import hashlib
import random

from tidemark.llm import exact_dedup as ed


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    out = [[i, min(g := groups[norm(t)])[1], len(g), False, hashlib.sha256(norm(t).encode()).hexdigest()] for i, t in rows]
    stays = {}
    for k, (i, t) in enumerate(rows):
        stays.setdefault(norm(t), []).append((-len(t or ""), i, k))
    for g in stays.values():
        out[min(g)[2]][3] = True
    return sorted(map(tuple, out))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", " \n", "a b", "ab", "a  b", "é ", "x" * 30_000, f"t{i % 7} u", "ñ ñ"])) for i in range(400)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string").repartition(5)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_dedup(docs).collect()]
    assert sorted(got) == brute(rows)
    assert ed.exact_dedup(docs.limit(0)).count() == 0


def test_spilling_and_comparing_contents(monkeypatch):
    rng = random.Random(4)
    records = [(hashlib.sha256(b"%d" % (k := rng.randrange(300))).digest(), b"%d" % k * 50, 1, k, i) for i in range(3000)]
    whole = sorted(map(tuple, ed.grace(records, 1 << 30)))
    assert whole == sorted(map(tuple, ed.grace(records, 5_000))) and len(whole) == len({r[1] for r in records})
    same_digest = [(b"x" * 32, c, 1, 1, i) for i, c in enumerate([b"a", b"b", b"a"])]
    assert sorted(r[2] for r in ed.grace(same_digest, 1 << 20)) == [1, 2]


def test_a_hot_text_is_salted(spark):
    docs = spark.createDataFrame([(i, "same  text" if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string").repartition(6)
    got = ed.exact_dedup(docs).filter("group_size > 1").agg({"group_size": "max", "keep_id": "max", "doc_id": "count"}).first()
    assert (got["max(group_size)"], got["max(keep_id)"], got["count(doc_id)"]) == (2000, 1, 2000)


def test_one_row_is_kept_whatever_ids_repeat(spark):
    """Rows are judged, not ids: of one id the longer text stays, and of rows alike one does."""
    least = -(2**63)
    rows = [(1, "a b"), (1, "ab"), (2, "x"), (2, "x"), (2, "x"), (least, "q"), (least + 1, "q"), (5, "q q"), (5, "qq"), (7, None), (least, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ed.exact_dedup(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    none = spark.createDataFrame([(None, "t"), (3, "t"), (None, "u"), (None, "u")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in ed.exact_dedup(none).collect()) == [("3", "3", True), ("None", "3", False), ("None", "None", False), ("None", "None", True)]
