"""The pipeline's stages, each on its predecessor's rows, against brute force."""

import base64
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from tallyloom.llm import decontam, jaccard, quality
from test_llm import brute_components, brute_lines, words

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_SLOTS", 1 << 14)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, rows_of(docs)
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]

    good = stage["quality_rules"](spark, docs, DATA).cache()
    assert good.columns == columns
    kept = rows_of(good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(kept[i] == before[i] for i in kept)
    assert not [i for i in kept if len(words(before[i].text)) < 20]
    failed = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("base_failed").collect()}
    assert {i for i in before if labels.get(i) == 1} - failed <= kept.keys() and not failed & kept.keys()

    lined = stage["line_dedup"](spark, good, DATA).cache()
    assert lined.columns == columns
    gone = brute_lines([(i, r.text) for i, r in kept.items()], 1)
    after = rows_of(lined)
    for i, r in kept.items():
        text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[i, r.text])
        assert (after[i].text, after[i].n_chars) == (text, len(text) if gone[i, r.text] else r.n_chars)

    single = stage["near_duplicates"](spark, lined, DATA).cache()
    assert single.columns == columns
    assert set(rows_of(single)) == {c for _, _, c in brute_components([(i, r.text) for i, r in after.items()], 5, 80)}

    clean = stage["decontamination"](spark, single, DATA).cache()
    assert clean.columns == columns
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = rows_of(clean)
    for i, r in rows_of(single).items():
        text = f" {' '.join(decontam.words_of(r.text))} "
        whole = any(f" {' '.join(w)} " in text for w in items)
        assert not (whole and i in left)
        if i not in left:  # something of an item is there
            assert any(f" {' '.join(w[a : a + 5])} " in text for w in items for a in range(len(w) - 4))

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in rows_of(stage["byte_bpe"](spark, clean, DATA)).items():
        assert r.token_ids == other.encode_ordinary(left[i].text)
        assert r.decoded_sha256 == hashlib.sha256(left[i].text.encode()).hexdigest()
    assert set(rows_of(corpus_pipeline.run(spark, DATA))) == set(left)


def test_stages_take_nulls_repeats_long_texts_and_other_columns(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    other = "\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [
        (1, prose, None, None, None, 1, True, "a"), (1, prose, None, None, None, 1, True, "a"), (2, None, "en", "s", 3, None, None, None), (3, "", "en", "s", 0, 2, False, "b"),
        (None, prose + " more", "en", None, 1, 3, None, "c"), (None, None, None, None, None, None, None, None), (4, prose, "en", "s", 1, 4, True, "d"),
        (5, other, None, "s", len(other), 5, True, "e"), (6, " ".join(f"long{i}" for i in range(30_000)), "en", "s", 1, 6, True, "f"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, bits long, maybe boolean, `row` string"
    stage = dict(corpus_pipeline.STAGES)
    whole = spark.createDataFrame(rows, schema).repartition(3)
    plain = lambda frame: sorted(map(tuple, frame.collect()), key=repr)

    good = plain(stage["quality_rules"](spark, whole, DATA))
    assert set(good) <= set(rows) and not [r for r in good if len(words(r[1])) < 20] and (5, *rows[7][1:]) in good
    lined = stage["line_dedup"](spark, whole, DATA)
    assert lined.columns == whole.columns
    # 1 and its repeat keep their line, 4 loses it, nulls stay null, a null id loses nothing
    assert plain(lined) == sorted([*rows[:6], (4, "", "en", "s", 0, 4, True, "d"), *rows[7:]], key=repr)
    single = stage["near_duplicates"](spark, whole, DATA)
    assert single.columns == whole.columns and plain(single) == sorted([r for r in rows if r[0] != 4], key=repr)
    clean = stage["decontamination"](spark, whole, DATA)
    assert clean.columns == whole.columns and plain(clean) == sorted(rows, key=repr)
    ids = stage["byte_bpe"](spark, whole, DATA).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in ids) == sorted((r[0] or 0, bool(r[1])) for r in rows)
    empty = spark.createDataFrame([], schema)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, DATA).count() == 0, name
