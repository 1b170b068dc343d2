"""Packing, toxicity and the pipeline."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import packing, toxicity
from fieldloom.llm.common import materialize


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents,attention", [(None, None), (4, None), (None, 300_000)])
def test_plan_places_every_piece_within_all_capacities(rule, documents, attention):
    rnd = random.Random(1)
    lengths = [rnd.choice([rnd.randint(1, 500), rnd.randint(1, 90)]) for _ in range(3000)]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    cap = packing.Capacity(1024, documents, attention, rule=rule)
    bins, seen = {}, {}
    for length, first, n, per, at, offset in packing.plan_bins(histogram, cap):
        assert first == seen.get(length, 0)
        seen[length] = first + n
        for r in range(n):
            bins.setdefault(at + r // per, []).append((offset + r % per * length, length))
    assert seen == histogram and sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024 and len(held) <= (documents or 1024) and sum(x * x for _, x in held) <= (attention or 1024**2)
    if not documents and not attention:
        assert len(bins) <= -(-sum(lengths) // 1024) + 2
    with pytest.raises(ValueError):
        packing.plan_bins({1025: 1}, cap)


ODD = ["a  b", "a   b ", "\n x", "x\n", "  y", "a  b", "", "it's  'll", "a\t\n b", "x\0 y", " lead", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|>x <|endoftext|><|endoftext|>", "end<|endoftext|>", "<|endoftext", "é ü 漢字 ab😀 c", "I'll they've 12 345 x1y2", None]


def test_packed_documents(spark):
    rnd = random.Random(4)
    texts = ODD + [" ".join(rnd.choice(["the", "of", "thanedble,", "ering\nErt", "x1"]) for _ in range(rnd.randint(1, 3000))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    packed = packing.pack_documents(df, with_ids=True)
    rows = packed.collect()
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        assert own == [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 1024) + 2
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert sum(r["length"] == 2 for r in rows) >= 1  # an added token is one id


def test_repeated_rows_null_ids_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rows = [(None, "a b"), (None, None), (1, "a b c"), (1, "a b c"), (1, "other"), *((i, "x " * (i % 5)) for i in range(300))]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, part int, rank int, base int")
    packed = packing.pack_documents(df, packing.Capacity(16)).collect()
    assert len(packed) == len(rows)
    held = {}
    for r in packed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        ends = [a + n for a, n in sorted(pieces)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(pieces)] and ends[-1] <= 16
    assert len(held) <= -(-sum(r["length"] for r in packed) // 16) + 2
    full = spark.createDataFrame([(1, 0, 16)], "doc_id long, piece int, length long")
    with pytest.raises(ValueError):
        packing.pack(full, packing.Capacity(16, attention=200))


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(5)
    plain = ["lorem", "ipsum", "dolor", "amet", "sit", "vita", "nova", "terra"]
    rows, labels = [], []
    for i in range(600):
        words, bad = rnd.choices(plain, k=rnd.randint(3, 60)), rnd.random() < 0.15
        if bad:
            words[rnd.randrange(len(words))] = "grubble" + rnd.choice(["", "ing", "ed", "s"])
        rows.append((i, " ".join(words), 0.1))
        labels.append((i, int(bad)))
    rows += [(1000, None, 0.1), (1001, "", 0.1), (None, "grubble", 0.1), (3, rows[3][1], 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    table = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, table)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    prior = toxicity.train(docs, table.limit(0))
    assert {r["score"] for r in toxicity.score(docs.limit(3), prior).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), prior).count() == 0


def test_toxicity_of_other_scripts_and_clashing_columns(spark):
    """N-grams are of code points, lower-cased by Unicode; what is kept keeps all its columns."""
    assert (toxicity.buckets("ДУРАК".encode()) == toxicity.buckets("дурак".encode())).all() and len(toxicity.buckets("дурак".encode())) == 5 + 4 + 3 + 2
    rows = [(i, ("ГЛУПЫЙ дурак " if i % 5 == 0 else "добрый друг ") + f"слово{i % 7}") for i in range(400)] + [(None, None), (500, ""), (3, "добрый друг x"), (3, "добрый друг x")]
    docs = spark.createDataFrame([(*r, 0.1, 9, True, "k") for r in rows], "doc_id long, text string, score double, predicted int, held_out boolean, keep_text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = kept.collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted([i for i in range(400) if i % 5] + [-1, 500, 3, 3])
    assert {(r["score"], r["predicted"], r["held_out"], r["keep_text"]) for r in got} == {(0.1, 9, True, "k")}


def test_log_count_ratios_and_steps_equal_plain_python(spark):
    """Buckets, ratios and the kept features against dictionaries; the fitted weights have no gradient left."""
    rnd = random.Random(11)
    rows = [(i, "".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    labels = {i: rnd.randint(0, 1) for i, _ in rows}
    settings = toxicity.Settings(max_features=40, rounds=4000, penalty=5.0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), settings)
    own = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    sets = {i: set(toxicity.buckets(t.encode()).tolist()) for i, t in own}
    for i, t in own:
        assert len(toxicity.buckets(t.encode())) == sum(max(0, len(t) + 2 - n + 1) for n in toxicity.ORDERS)
    pos, neg = ([sets[i] for i, _ in own if labels[i] == y] for y in (1, 0))
    found = {}
    for b in set().union(*sets.values()):
        p, q = (sum(b in s for s in side) for side in (pos, neg))
        if p + q >= settings.min_rows:
            r = np.log((p + 1) / (len(pos) + 2)) - np.log((q + 1) / (len(neg) + 2))
            found[b] = (abs(r) * np.sqrt(p * len(neg) / len(pos) + q), r)
    kept = sorted(sorted(found, key=lambda b: (-found[b][0], b))[:40])
    assert model.buckets.tolist() == kept
    x = np.array([[found[b][1] * (b in sets[i]) for b in kept] for i, _ in own])
    y = np.array([labels[i] for i, _ in own])
    w = model.weights / np.array([found[b][1] for b in kept])
    error = 1 / (1 + np.exp(-(x @ w + model.intercept))) - y
    assert np.abs(x.T @ error / len(y) + settings.penalty / len(y) * w).max() < 1e-4 and abs(error.mean()) < 1e-4


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    here = "/root/testdata/sf0.001"
    if not Path(here).exists():
        pytest.skip("no test tables")
    docs = first = spark.read.parquet(f"{here}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, here)
        out = materialize(out, name)
        rows = out.collect()
        assert 0 < len(rows)
        if name != "best_fit_packing":
            assert out.columns == first.columns and len(rows) <= docs.count()
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "simhash_near_dedup":
            assert len({r["doc_id"] for r in rows}) == len(rows) < docs.count()
            assert all(set(r["text"].split("\n")) <= set(texts[r["doc_id"]].split("\n")) | {""} for r in rows)
        docs = out


STRANGE = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, gone string, root int, label int, topic string, p int, key int, length int, text_key int"


def test_pipeline_stages_on_strange_tables(spark, tmp_path):
    """Empty tables, nulls, empty and very long texts, repeated rows and ids, columns of the operators' own names."""
    extra = (0.5, 1, "g", 2, 3, "t", 4, 5, 6, 7)
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = ["one two three four five\nsix seven eight nine ten", None, "", " \n ", long_text, "one two three four five", "k l m n o p q", "k l m n o p q", "other words stand here now"]
    rows = [(i if i != 6 else 7, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t), *extra) for i, t in enumerate(texts)]
    rows += [(None, "no id at all here", "en", "s", 17, *extra), (None, None, None, None, None, *extra), rows[0], rows[0]]
    spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    for empty in (False, True):
        docs = spark.createDataFrame([] if empty else rows, STRANGE)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            assert empty == (not got)
            if name != "best_fit_packing":
                assert out.columns == docs.columns and all(tuple(r)[5:] == extra for r in got)
    docs = spark.createDataFrame(rows, STRANGE)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == len(rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_chars"]) for r in stages["line_dedup"](spark, docs, str(tmp_path)).where("text is not null").collect())
    first = "one two three four five\nsix seven eight nine ten"
    assert (5, "", 0) in got and got.count((0, first, len(first))) == 3 and len([x for x in got if x[1] == "k l m n o p q"]) == 2
    near = [(r["doc_id"], r["text"]) for r in stages["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()]
    assert len(near) == len(set(near)) == 7 and (1, None) in near and (7, "k l m n o p q") in near and (None, "no id at all here") in near


def test_run_equals_the_stages_one_by_one(spark):
    here = "/root/testdata/sf0.001"
    if not Path(here).exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{here}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, here)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, here)) == key(docs)
