"""The corpus pipeline stage by stage against brute force on a small table."""

import base64

import public_tokenizers

import corpus_pipeline
from ravel.llm import bpe, queries
from test_llm_operators import SF, brute_lines, joined, sets_of


def test_stages(spark):
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = queries.table(spark, SF, "documents")
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    def rows(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    good = stages[0](spark, docs, SF)
    assert good.columns == columns and set(rows(good)) <= set(rows(docs)) and len(rows(good)) > 0.7 * docs.count()

    lined = stages[1](spark, good, SF)
    before, after = rows(good), dict(rows(lined))
    assert lined.columns == columns and set(after) == {i for i, _ in before}
    for i, n, dropped, _ in brute_lines(before):
        assert len(after[i].split("\n")) == n - dropped or (n == dropped and after[i] == "")

    single = stages[2](spark, lined, SF)
    sets = sets_of(rows(lined))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert [i for i, _ in rows(single)] == sorted(set(joined(ids, links).values())) and single.columns == columns

    clean = stages[3](spark, single, SF)
    own = [s for s in (sets_of([i])[i[0]] for i in items) if s]
    assert [i for i, _ in rows(clean)] == [i for i, t in rows(single) if not any(10 * len(s & sets[i]) >= 8 * len(s) for s in own)]
    assert clean.columns == columns

    last = stages[4](spark, clean, SF)
    assert rows(last) == rows(clean)
    for r in last.collect():
        assert list(r.ids) == library.encode_ordinary(r.text)


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in entry.queries() if k.startswith("op") and k[2].isdigit()}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"] and out.count() > 0
