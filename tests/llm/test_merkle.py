"""The manifest against trees built leaf by leaf, over odd rows and many levels."""

import hashlib
import zlib

import pytest

from deltaloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text=None):
    doc_id, own, lang, source, n = row
    return h(*[field(v) for v in (doc_id, source, lang, n, own if text is None else text)])


def climb(nodes, at):
    """(top, levels): the siblings left and right of node ``at`` on each level."""
    way = []
    while len(nodes) > 1:
        low = at - at % 16
        run = nodes[low : low + 16]
        way.append((run[: at - low], run[at - low + 1 :]))
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], way


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
    subroots = [climb([leaf(r) for r in by[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        mine = [leaf(r) for r in by[s]]
        root, above = climb(subroots, k)
        for at, r in enumerate(by[s]):
            way = climb(mine, at)[1] + above
            seen = mine[at]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                seen = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in way:
                seen = h(*left, seen, *right)
            proof = h(*[x for left, right in way for x in left + right])
            out.append((r[0], mine[at], subroots[k], root, proof, seen, seen == root))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def many():
    rows = [(i, f"Text {i} ÄB {'x' * (i % 7)}", "en", "big", i) for i in range(300)]
    rows += [(1000 + i, f"Only {i}", None, f"s{i}", None) for i in range(20)]
    return rows


def odd():
    return [
        (1, "Lone LEAF", "en", None, 9), (5, None, None, "", 0), (7, "", "en", "", 0), (None, "No Id", "en", "a", 5),
        (None, None, None, "a", None), (8, "Twice", "en", "a", 5), (8, "Twice", "en", "a", 5), (8, "Other", "en", "a", 5),
        (9, "Ü" * 100_000 + " END", "de", "é", 100_004), (10, "y", "en", "z", -3), (-4, "Negative ID", "en", "a", 1),
    ]


@pytest.mark.parametrize("rows", [many, odd], ids=["many", "odd"])
def test_equals_trees_built_leaf_by_leaf(spark, rows):
    found = merkle.manifest(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got(found) == brute(rows())


def test_lower_levels_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", 3)
    rows = many()
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_document_and_none(spark):
    one = [(5, "Alone", "en", "s", 5)]
    found = got(merkle.manifest(spark.createDataFrame(one, SCHEMA)))
    assert found == brute(one) and found[0][4] == h() and found[0][1] == found[0][3]
    assert got(merkle.manifest(spark.createDataFrame([], SCHEMA))) == []


def test_tampering_is_found_and_nothing_else(spark):
    rows = many()
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)


def test_clashing_columns_are_not_read(spark):
    from pyspark.sql import functions as F

    rows = odd()
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "level", "place", "n", "seen", "leaf", "_at", "_n", "_part", "root"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert got(merkle.manifest(docs)) == brute(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got(merkle.op11_merkle_manifest(spark, sf)) == brute(rows)
