import corpus_pipeline
from symgraph.llm import bpe, common, line_dedup, mixing, quality_rules, simhash
from tests import oracle
from tests.llm import data
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_line_dedup import cleaned
from tests.llm.test_simhash import brute as brute_copies


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what its predecessor kept; the rows of the last are those of run()."""
    docs = common.read(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "byte_bpe"]

    kept = common.materialize(stages["quality_rules"](spark, docs, sf_dir), "t")
    want = {r[0] for r in oracle.connect(sf_dir).sql(quality_rules.SQL).select("doc_id").fetchall()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns

    lines = common.materialize(stages["line_dedup"](spark, kept, sf_dir), "t")
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    clean = {(i, t) for i, t, n in cleaned(rows, brute_lines(rows)) if not n or t.strip(" \t\r\n")}
    assert {(r["doc_id"], r["text"]) for r in lines.collect()} == clean and lines.columns == docs.columns
    assert lines.where("n_chars <> length(text)").count() == 0

    unique = common.materialize(stages["near_dedup"](spark, lines, sf_dir), "t")
    ordered = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    drop = {ordered[k][0] for k in brute_copies([t for _, t in ordered])}
    left = {r["doc_id"] for r in unique.collect()}
    assert left >= {i for i, _ in ordered} - drop and len(left & drop) <= 0.1 * len(drop)

    mixed = common.materialize(stages["source_mixing"](spark, unique, sf_dir), "t")
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mix(unique).collect()}

    last = stages["byte_bpe"](spark, mixed, sf_dir)
    assert bpe.decode(last).exceptAll(mixed.select("doc_id", "text")).count() == 0 and last.count() == mixed.count()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r["doc_id"] for r in last.collect()}


def test_odd_input(spark, sf_dir):
    for d in (data.odd_docs(spark), data.empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            columns = d.columns
            d = common.materialize(stage(spark, d, sf_dir), "t")
            assert name == "byte_bpe" or d.columns == columns


def test_operators_are_the_ten():
    from symgraph.llm import queries

    assert sorted(queries.queries()) == sorted("op1_toxicity op2_simhash_dedup op3_quality_rules op4_token_counts op5_embedding_dedup op6_byte_bpe op7_line_dedup op8_source_mixing op9_quality_classifier op10_warc".split())
    assert line_dedup.SQL and simhash.BITS


def test_the_mix_keeps_its_order_in_the_last_stage(spark):
    """Files of falling and rising sizes: a scan packs them by size, position goes by the mix."""
    rows = [(i, f"{i} " * (1 + 40 * (i * 7919 % 23)), "en", "abc"[i % 3 if i < 900 else 0], 0) for i in range(1200)]
    d = spark.createDataFrame(rows, data.DOCS)
    stages = dict(corpus_pipeline.STAGES)
    mixed = common.materialize(mixing.mix_documents(d, block_chars=2000), "t")
    want = [r["doc_id"] for r in mixing.mix(d, block_chars=2000).orderBy("slot", "in_block").collect()]
    for frame in (mixed, mixing.mix_documents(d, block_chars=2000)):
        last = common.materialize(stages["byte_bpe"](spark, frame, ""), "t")
        got = sorted((r["position"], r["doc_id"]) for r in last.collect())
        assert [p for p, _ in got] == list(range(1200)) and [i for _, i in got] == want


def test_position_goes_by_the_number_of_the_part(spark, tmp_path):
    for n, rows in ((99_999, 3), (100_000, 50), (7, 20)):
        spark.range(n, n + rows).coalesce(1).write.parquet(f"{tmp_path}/one{n}")
        (file,) = (tmp_path / f"one{n}").glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        file.rename(tmp_path / "all" / file.name.replace("part-00000", f"part-{n:05d}"))
    got = common.numbered(spark.read.parquet(f"{tmp_path}/all"), ["id"], "t").orderBy("position").collect()
    assert [(r["position"], r["id"]) for r in got] == list(enumerate([*range(7, 27), *range(99_999, 100_002), *range(100_000, 100_050)]))
