"""The five stages on odd rows, and the whole pipeline against its parts by brute force."""

import corpus_pipeline
import public_tokenizers
import pytest
from graphloom.llm import quality
from pyspark.sql import functions as F
from test_documents import WORD, brute_components, brute_measures, brute_passages
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def texts(spark):
    """Long clean texts of one language."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 900 AND 4000").orderBy("doc_id").collect()
    out = []
    for r in rows:  # none has a passage of another
        if len(out) < 40 and not brute_passages([*enumerate(out), (len(out), r["text"])], 50):
            out.append(r["text"])
    return out


def docs(spark, rows, extra="row string, spans string, component_id long"):
    """doc_id and text, the other columns of documents, and columns whose names stages use inside."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "p", 7) for i, t in rows], kinds)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_odd_rows(spark, texts, name):
    clean = [t for t in texts if quality_passes(t)][:6]
    rows = [(1, clean[0]), (2, clean[1]), (2, clean[2]), (None, clean[3]), (3, None), (4, ""), (5, clean[4]), (5, clean[4]), (None, None)]
    table = docs(spark, rows).union(docs(spark, [(100 + i, t) for i, t in enumerate(texts[10:])]))
    out = STAGES[name](spark, table, SF)
    assert out.columns == table.columns and out.dtypes == table.dtypes
    got = sorted(((r["doc_id"], r["text"]) for r in out.where("doc_id < 100 OR doc_id IS NULL").collect()), key=str)
    whole = [(1, clean[0]), (2, clean[1]), (2, clean[2]), (None, clean[3]), (5, clean[4]), (5, clean[4])]
    want = whole if name != "near duplicates" else [(1, clean[0]), (2, min(clean[1:3])), (None, clean[3]), (3, None), (4, ""), (5, clean[4]), (None, None)]
    assert got == sorted(want, key=str)
    assert all((r["row"], r["spans"], r["component_id"]) == ("r", "p", 7) for r in out.collect())
    assert STAGES[name](spark, table.limit(0), SF).collect() == []


def quality_passes(text):
    words, _, symbols, _, repeats, _ = brute_measures(text)
    return words >= 50 and 2 * repeats <= words and 10 * symbols <= words


def test_passages_of_one_id_with_several_texts(spark, texts):
    a, b, c = (" ".join(t.split()[:80]) for t in texts[:3])
    rows = [(1, a), (2, f"head {a} tail"), (2, f"other {b}"), (3, c)]
    out = {(r["doc_id"], r["text"].split()[0]): r["text"] for r in STAGES["repeated passages"](spark, docs(spark, rows), SF).collect()}
    assert out[2, "other"] == f"other {b}" and out[3, c.split()[0]] == c
    assert out[2, "head"] in (f"head {a} tail", "head  tail")  # it takes part, or the other text does


def test_whole_pipeline(spark):
    """What each stage keeps is what brute force keeps of what it got."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, SF).collect(), stage(spark, now, SF).schema)
        after = now.collect()
        if name == "quality":
            failed = [n for n, _ in quality.RULES]
            book = {r["doc_id"]: r["failed_bits"] for r in quality.ledger(spark.createDataFrame(list(before.values()))).collect()}
            assert {r["doc_id"] for r in after} == {i for i, bits in book.items() if not bits} and len(failed) == 8
            assert all(quality_passes(r["text"]) for r in after)
        if name == "near duplicates":
            kept = {i for i, _, _, own in brute_components([(i, r["text"]) for i, r in before.items()], 5, 80) if own}
            assert {r["doc_id"] for r in after} == kept
        if name == "repeated passages":
            cut = brute_passages([(i, r["text"]) for i, r in before.items()], 50)
            left = {i: [x for k, x in enumerate(WORD.findall(r["text"])) if k not in cut.get(i, ())] for i, r in before.items()}
            assert {r["doc_id"]: WORD.findall(r["text"]) for r in after} == {i: x for i, x in left.items() if x}
        if name == "packing":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            sizes = {}
            for r in after:
                sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
            assert sizes == {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in before.items()}
        else:
            assert now.columns == columns and {r["doc_id"] for r in after} <= before.keys() and after
    assert now.count() == corpus_pipeline.run(spark, SF).agg(F.count("*")).first()[0]
