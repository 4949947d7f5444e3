import corpus_pipeline
import pytest

from presswork.llm import langid, outliers, simhash
from presswork.llm.queries import MIX_OTHER, MIX_SEED, MIX_WEIGHTS
from tests.llm import cases
from tests.llm.test_mixing import brute_copies
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_statements(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "quality", "near_dedup", "mix", "pack"]

    spoken = stages["language"](spark, docs, SF)
    wanted = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und"}
    assert {r.doc_id for r in spoken.collect()} == wanted

    good = stages["quality"](spark, spoken, SF)
    assert {r.doc_id for r in good.collect()} == {
        r.doc_id for r in outliers.assess(spoken).filter("kept").collect()
    }

    rows = [tuple(r) for r in good.collect()]
    single = stages["near_dedup"](spark, good, SF)
    named = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    kept = [tuple(r) for r in single.collect()]
    assert sorted(r[0] for r in kept) == sorted(set(named))

    mixed = stages["mix"](spark, single, SF)
    assert mixed.columns == docs.columns
    copies = brute_copies(kept, MIX_WEIGHTS, MIX_OTHER, None, MIX_SEED)
    assert mixed.count() == sum(copies.values())

    plan = stages["pack"](spark, mixed, SF)
    packed = plan.select("doc_id").filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in packed} == {k[0]: n for k, n in copies.items()}


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    pieces = ["doc_id", "piece", "n_tokens"]
    assert cases.as_set(got.select(pieces)) == cases.as_set(docs.select(pieces))


@pytest.mark.parametrize("rows", [[], cases.ROWS])
def test_odd_tables_pass_through(spark, rows):
    docs = cases.clashing(spark, ["score", "pair", "root", "copy", "text_mark"], rows)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name != "pack":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs = after
    assert (docs.count() == 0) == (not rows)
    assert simhash.near_duplicates(cases.documents(spark, rows)).count() == len(rows)
