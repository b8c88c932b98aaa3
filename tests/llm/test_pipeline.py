import base64
import random
import string

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


def test_stages_keep_columns_and_work_on_all(spark, some_docs):
    sf_dir = "/root/testdata/sf0.001"
    docs = some_docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        assert out.schema.names == docs.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[0] == counts[1] and counts[-1] > 0.5 * counts[0]
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    whole = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, pieces.select(*key).collect()))


def test_odd_rows_pass_through(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() > 0


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]


#: Prose in languages that the documents do not have.
FOREIGN = [
    "Ali okula gitmek için sabah erkenden kalktı ve kahvaltısını yaptıktan sonra otobüse binerek şehre doğru yola çıktı.",
    "Suomen kesä on lyhyt mutta kaunis ja ihmiset viettävät paljon aikaa mökillä järven rannalla.",
    "Wczoraj wieczorem poszliśmy do kina na nowy film, który bardzo nam się podobał.",
    "Watoto wanapenda kucheza mpira shuleni baada ya masomo yao ya asubuhi.",
    "Tegnap este moziba mentünk a barátainkkal, utána pedig vacsoráztunk egy hangulatos étteremben."]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_language_stage_drops_gibberish_and_unlearned_languages(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    draw = random.Random(5)
    letters = [" ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 10))) for _ in range(n))
               for n in [6, 20, 100, 500] * 5]
    encoded = [base64.b64encode(draw.randbytes(n)).decode() for n in (30, 300, 3000)]
    odd = letters + encoded + FOREIGN
    # Some carry the label of a learned language, so that they take part in learning.
    planted = spark.createDataFrame([(10_000_000 + i, t, "en" if i % 2 else None, "src0", len(t)) for i, t in enumerate(odd)],
                                    "doc_id long, text string, lang string, source string, n_chars int")
    planted = planted.select(*(F.col(f.name).cast(f.dataType) for f in docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs.unionByName(planted), sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_evidence_limit_uses_every_held_out_row(spark, monkeypatch):
    """A bound on the rows that set the limit is not there any more: one of 1 leaves it as it is."""
    from reelsight.llm import language_id as li
    words = "the quick brown fox jumps over lazy dogs near old stone bridges while rain falls".split()
    other = "der schnelle braune fuchs springt hoch und weit am alten fluss entlang bis zum wald".split()
    docs = spark.createDataFrame([(i, " ".join(x[(i // 2 + k) % len(x)] for k in range(9)), ("en", "de")[i % 2])
                                  for i in range(600) for x in ((words, other)[i % 2],)],
                                 "doc_id long, text string, lang string")
    model = li.fit(docs.where(~li.held_out()))
    packed, made = model.packed(), []

    def scorer():
        if not made:
            made.append(li._Evidence(li.LanguageModel.unpacked(packed)))
        return made[0]

    want = li.evidence_limit(docs, model, scorer)
    monkeypatch.setattr(li, "LIMIT_ROWS", 1, raising=False)
    assert li.evidence_limit(docs, model, scorer) == want
    assert want[1] > 0.5
