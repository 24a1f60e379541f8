import __spark_entry__
import corpus_pipeline
import tiktoken
from test_simhash import plain_groups
from test_text_operators import plain_hits

from usagelens.llm import bpe, langid, pii
from usagelens.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [r for r in docs if any(c.isalpha() for c in r.text or "")]
    first = {(doc, root) for doc, _, root in plain_groups([(r.doc_id, r.text) for r in kept])}
    kept = [r for r in kept if (r.doc_id, r.doc_id) in first]
    kept = [r for r in kept if not plain_hits(r.text, items)[1]]
    masked = pii.mask_pii(spark.createDataFrame([(r.doc_id, r.text) for r in kept], "doc_id long, text string"))
    ranks = bpe.load_ranks(VOCABULARY)
    peer = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {r.doc_id: peer.encode_ordinary(r.text) for r in masked.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == expected
    assert 0 < len(got) < len(docs)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF).dtypes == docs.dtypes


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).union(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema))
    for given in (odd, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            assert step(spark, given, SF).count() <= given.count()


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {name.split("_")[0] for name in QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(QUERIES) <= set(names)
