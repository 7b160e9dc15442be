"""The pipeline's stages, one after the other, against plain versions of each."""

import hashlib

import brute
import corpus_pipeline
from tracelake.llm import bpe, mixing
from tracelake.llm.registry import _tokenizer
from test_operators import domain


def plain(rows):
    """rows: doc_id -> (text, lang, source); labels too few to certify a cutoff."""
    import tiktoken

    kept = {}
    for i, (t, lang, source) in rows.items():
        q = brute.quality(t)
        if not (q[0] < 50 or 100 * q[4] > 50 * q[0]):
            kept[i] = (t, lang, source)
    gone = brute.gone_lines([(i, t) for i, (t, _, _) in kept.items()])
    kept = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(i, []))), lang, source) for i, (t, lang, source) in kept.items()}
    found = brute.jaccard([(i, t) for i, (t, _, _) in kept.items()])
    kept = {i: v for i, v in kept.items() if found[i][1] == i}
    taken = {k[0] for k in brute.mixed([(i, *v) for i, v in kept.items()], mixing.STAGE_PLAN, domain)}
    path, pattern = _tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
    out = set()
    for i in taken:
        ids = own.encode_ordinary(kept[i][0])
        out.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[i][0].encode()).hexdigest()))
    return out


def test_pipeline(spark, small_dir):
    rows = {r.doc_id: (r.text, r.lang, r.source) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, small_dir).collect()} == plain(rows)


def test_stages_keep_columns(spark, docs, small_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mixing", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
    given = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, small_dir)
        assert given.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).count() == docs.count()


def test_stages_on_an_empty_table(spark, empty, small_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small_dir).count() == 0
