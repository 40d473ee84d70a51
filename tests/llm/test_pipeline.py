"""The pipeline's stages on the smallest tables, each against what its operator decides."""

import corpus_pipeline
from deltasieve.llm import exact_dedup, mixing, near_copies, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wanted = [
        lambda d: quality.score(d, labels, corpus_pipeline.THRESHOLD).where("keep").count(),
        lambda d: exact_dedup.exact_duplicates(d).where("kept").count(),
        lambda d: near_copies.groups(d).select("root").distinct().count(),
        lambda d: mixing.mix(d, ["doc_id"]).selectExpr("sum(size(draws))").first()[0],
        lambda d: d.count(),
    ]
    assert len(corpus_pipeline.STAGES) == 5
    for i, ((_, stage), want) in enumerate(zip(corpus_pipeline.STAGES, wanted, strict=True)):
        n = want(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() == n > 0
        if i < 4:
            assert docs.columns == columns
        counts.append(n)
    assert counts[1] <= counts[0] and counts[2] < counts[1]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.reject_poor(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    both = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in both}
    assert kept[1] >= 0.98 * labels.where("quality = 1").count()
    assert kept.get(0, 0) <= 0.25 * labels.where("quality = 0").count()


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    text = "one two three four five six seven eight nine ten " * 3
    other = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 9), (2, text + " ", "en", "a", 9), (1, text, "en", "a", 9), (3, text + "more", None, None, None), (None, other, "fr", "b", 1), (None, None, None, None, None), (4, "", "en", "a", 0), (5, other + " x" * 30_000, "en", "b", 5)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = ["row", "root", "k1", "shard", "keep", "draw", "label", "nth", "h", "order"]
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], names + "".join(f", {c} int" for c in extra))
    columns, left = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        left.append(sorted((r["doc_id"] or 0 for r in docs.collect()), key=str))
    assert left[1] == sorted(set(left[0]) - {2} if 1 in left[0] else set(left[0]), key=str) or len(left[1]) <= len(left[0])
    assert len(left[2]) <= len(left[1]) and left[4] == left[3]
    assert sum(r["n_tokens"] for r in docs.collect()) == sum(len(r["ids"]) for r in docs.collect()) // 4


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
