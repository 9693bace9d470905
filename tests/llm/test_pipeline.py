import random

import pytest
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_simhash import brute_components

import corpus_pipeline as C
from deltaloom.llm import language, packing, pii


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(9)
    stems = {"xa": ["the", "ing", "ou", "wh", "sh", "a", "er"], "yb": ["für", "sch", "ung", "ß", "ei", "o", "ni"]}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word("xa") for _ in range(20))) for i in range(5)]
    rows = []
    for d in range(150):
        lang = ("xa", "yb")[d % 2]
        words = [word(lang) for _ in range(rng.randint(10, 120))]
        if d % 13 == 0:
            words.insert(3, f"user{d}@host.example.org")
        if d % 17 == 0:
            words[5:5] = items[d % 5][1].split()
        rows.append((d, " ".join(words), lang, "s", 0))
    rows += [(200 + d, rows[d][1] + " more", rows[d][2], "s", 0) for d in range(0, 60, 7)]
    rows += [(300 + d, rows[d][1], rows[d][2], "s", 0) for d in range(0, 90, 11)]
    rows += [(400, None, "xa", "s", 0), (401, "12 34", "xa", "s", 0), (402, "", None, None, None), rows[8], (None, "the ing ou wh", None, "s", 4)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def test_stages_match_brute_force(spark, sf):
    path, rows, items = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = C.language_id(spark, docs, path)
    predicted = {(r.doc_id, r.lang_pred) for r in language.predict(docs, language.fit(docs)).collect()}
    gone = {d for d, lang in predicted if lang == "und"}
    assert gone == {400, 401, 402} and kept.columns == columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in gone)

    unique = C.near_dedup(spark, kept, path)
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    named = brute_components(pairs)
    assert unique.columns == columns
    want = {d for d, _, c in named if d == c}
    assert sorted(str(r.doc_id) for r in unique.collect()) == sorted(map(str, want))

    clean = C.decontamination(spark, unique, path)
    left = [(r.doc_id, r.text) for r in unique.collect()]
    dirty = {d for d, *_ in brute_leaks(left, items)}
    assert dirty and clean.columns == columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in left if d not in dirty)

    masked = C.mask_pii(spark, clean, path)
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        assert (r.text == before[r.doc_id]) == ("@" not in before[r.doc_id])
        assert "@" not in r.text
    assert masked.columns == columns

    packed = C.pack(spark, masked, path).collect()
    assert {r.doc_id for r in packed} == set(before)
    whole = C.run(spark, path).collect()
    digest = lambda out: sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in out)
    assert digest(whole) == digest(packed)
    assert len({r.sequence_id for r in whole}) == -(-sum(r.length for r in whole) // packing.LIMIT)


def test_contract(spark):
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None and pii.KINDS == ("email", "ip", "card", "phone")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("langs", [(), ("xa",), ("xa", "yb")])
def test_few_languages_are_not_dropped(spark, sf, langs):
    path, _, _ = sf
    kept = F.when(F.col("lang").isin(*langs), F.col("lang")) if langs else F.lit(None).cast("string")
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("lang", kept)
    out = C.language_id(spark, docs, path)
    want = [r.doc_id for r in docs.collect() if r.doc_id not in (400, 401, 402)]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect())


def test_least_score_is_reachable():
    assert C.least_score(0) == C.least_score(1) == 0
    assert C.least_score(4) == pytest.approx(0.3)
    assert all(1 / n < C.least_score(n) < 0.54 for n in range(2, 100))
