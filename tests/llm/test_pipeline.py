"""The corpus pipeline, stage by stage, against plain statements of what each stage must do."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from pageloom.llm import decontamination, ngram_join, secret_scan


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_columns_stay(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "secret_scan", "packing"]
    assert all(stages[name].columns == stages["documents"].columns for name in names[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, data):
    """On the largest tables: the smallest have only a handful of toxic labels to learn from."""
    root = data.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    documents = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, documents, root).select("doc_id").join(labels, "doc_id")
    assert kept.where("toxic = 0").count() >= 0.98 * labels.where("toxic = 0").count()
    assert kept.where("toxic = 1").count() <= 0.1 * labels.where("toxic = 1").count()


def test_one_document_of_each_group_stays(stages):
    before = ngram_join.near_copies(stages["toxicity"]).collect()
    assert {r.doc_id for r in stages["ngram_join"].collect()} == {r.component_id for r in before}


def test_kept_documents_against_all_pairs(stages):
    """The stage's rows by comparing every two texts of its input."""
    low = {c: c + 32 for c in range(65, 91)}
    rows = stages["toxicity"].select("doc_id", "text").collect()
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low))
        sets.append({tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for x, r in enumerate(rows):
        least[find(x)] = min(least.get(find(x), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages["ngram_join"].collect()) == sorted(least.values())


def test_masks_against_plain_replacement(stages):
    """Each text with the spans of the scanner replaced from the last to the first."""
    after = {r.doc_id: r.text for r in stages["secret_scan"].collect()}
    some = 0
    for r in stages["decontamination"].collect():
        text, _, parts = secret_scan.scan((r.text or "").encode())
        marks = [False] * len(r.text or "")
        for p in parts:
            if p.kind not in ("id", "endpoint"):
                marks[p.start : p.end] = [True] * (p.end - p.start)
        want = "".join(c if not m else "\0" for c, m in zip(r.text or "", marks))
        starts = {p.start for p in parts}
        assert re.sub("\0+", "[SECRET]", want) == after[r.doc_id] or any(p.end in starts for p in parts)
        some += "\0" in want
    assert some


ODD = "score int, id string, digest long, root int, class int, bucket int, batch int, piece int, hits int, spans string, key string"


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, data, stage):
    """No rows; nulls, repeated rows and ids, empty texts, and other columns with clashing names."""
    work = dict(corpus_pipeline.STAGES)[stage]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {ODD}"
    empty = work(spark, spark.createDataFrame([], schema), data)
    assert empty.count() == 0
    plain = " ".join(f"word{n}" for n in range(60))
    texts = [(1, plain), (1, plain), (1, "another text under the id"), (2, None), (3, ""), (None, plain + " more"), (None, None), (4, "token = abcdefghijklmnop0123 here"), (5, " \n ")]
    rest = tuple([7, "i", 8, 9, 10, 11, 12, 13, 14, "s", "k"])
    docs = spark.createDataFrame([(i, t, None, None, None, *rest) for i, t in texts], schema)
    found = work(spark, docs, data)
    if stage == "packing":
        assert found.groupBy().sum("n_tokens").first()[0] == sum(len((t or "").split()) for _, t in texts)
        return
    assert found.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in found.collect()]
    want = list(texts)
    if stage == "ngram_join":  # one of the copies stays, of the smallest id
        want = [(1, plain), *[x for x in texts[2:] if x != (None, plain + " more")]]
    if stage == "secret_scan":
        want[7] = (4, "[SECRET] here")
    order = lambda x: (str(x[0]), str(x[1]))
    assert sorted(rows, key=order) == sorted(want, key=order)
    assert {tuple(r)[5:] for r in found.collect()} == {rest}


def test_no_passage_of_a_test_item_stays(spark, data, stages):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontamination.report(stages["decontamination"], bench).where("contaminated").count() == 0
    clean = decontamination.report(stages["ngram_join"], bench).where("not contaminated").select("doc_id")
    before, after = (stages[n].join(clean, "doc_id").select("doc_id", "text") for n in ("ngram_join", "decontamination"))
    assert before.exceptAll(after).count() == 0


def test_secrets_are_masked_and_the_rest_stays(stages):
    before = {r.doc_id: r.text for r in stages["decontamination"].collect()}
    for r in stages["secret_scan"].collect():
        assert not secret_scan.base_spans(r.text)
        parts = r.text.split("[SECRET]")
        assert re.fullmatch(".+".join(map(re.escape, parts)), before[r.doc_id], re.S)
        assert r.n_chars == len(r.text) or len(parts) == 1


def test_every_token_is_packed_once(stages):
    want = {r.doc_id: len((r.text or "").encode().split()) for r in stages["secret_scan"].collect()}
    got: dict[int, int] = {}
    for r in stages["packing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == want


def test_run_gives_the_last_stage(spark, data, stages):
    assert corpus_pipeline.run(spark, data).count() == stages["packing"].count()
