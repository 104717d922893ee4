"""The pipeline stage by stage against plain Python, and every operator where the package is shipped to the workers."""

import json
import math
import os
import re
import subprocess
import sys
import textwrap
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanworks.llm import line_labels, quality_model
from tests.llm.test_texts import WORD, counts_by_force, groups_by_force, low, within

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def small(spark, data_dir, tmp_path_factory):
    """A directory with some of the documents, odd ones among them, and their labels."""
    path = f"file://{tmp_path_factory.mktemp('small')}"
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").where("length(text) < 6000")
    odd = [None, "", " \n ", "one\none\none", "word " * 300, "a b c d e f\n" * 30]
    odd = spark.createDataFrame([(10**9 + k, t, "en", "odd", len(t or "")) for k, t in enumerate(odd)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{data_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def score_by_hand(model, text):
    """One document through the gated attention, by the formulas."""
    rows = next(quality_model.bags(pa.array([text], pa.string())))
    p = model.parts
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    hidden, energy = [], []
    for row in rows.astype(float):
        x = [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(a * w for a, w in zip(x, p["encode"][:, j])) + p["shift"][j]) for j in range(len(p["shift"]))]
        gated = [
            math.tanh(sum(a * w for a, w in zip(h, p["value"][:, j]))) * sigmoid(sum(a * w for a, w in zip(h, p["gate"][:, j])))
            for j in range(p["value"].shape[1])]
        hidden.append(h)
        energy.append(math.exp(sum(g * w for g, w in zip(gated, p["weight"]))))
    pooled = [sum(e * h[j] for e, h in zip(energy, hidden)) / sum(energy) for j in range(len(hidden[0]))]
    return sigmoid(sum(z * w for z, w in zip(pooled, p["out"])) + p["bias"][0])


def labels_by_hand(chain, rows):
    """The best path of one text, by the recurrence over both states."""
    scores, step = chain.emissions(rows), chain.parts["step"]
    best, back = [scores[0][s] + chain.parts["start"][s] for s in (0, 1)], []
    for emitted in scores[1:]:
        options = [[best[a] + step[a][b] for a in (0, 1)] for b in (0, 1)]
        back.append([int(o[1] >= o[0]) for o in options])
        best = [max(o) + emitted[b] for b, o in enumerate(options)]
    path = [int(best[1] >= best[0])]
    for choice in reversed(back):
        path.append(choice[path[-1]])
    return path[::-1]


def content_by_hand(chain, text):
    """Words of a text in lines that are content; the lines are those with a word."""
    from spanworks.llm.features import stretch_features
    from spanworks.llm.words import split_words, text_pieces

    lines = [x for x in text.split("\n") if WORD.search(x)]
    if not lines:
        return 0
    rows = []
    for _, _, data, bounds in text_pieces(pa.array([text], pa.string())):
        words = split_words(data, bounds, lower=False)
        rows = stretch_features(words, line_labels.split_lines(words).edges)
    assert len(rows) == len(lines)
    return sum(len(WORD.findall(x)) for x, s in zip(lines, labels_by_hand(chain, rows)) if s)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count() > 150

    model = quality_model.fit(docs, labels)
    scores = {i: score_by_hand(model, r.text or "") for i, r in rows.items()}
    said = {r.doc_id: r.score for r in quality_model._scored(docs.select("doc_id", "text"), model, 1).collect()}
    again = {r.doc_id: r.score for r in quality_model.predictions(docs, labels).collect()}
    assert all(abs(said[i] - s) < 1e-3 for i, s in again.items())
    assert {i: (said[i], s) for i, s in scores.items() if abs(said[i] - s) > 1e-9} == {}
    first = stages["quality_classifier"](spark, docs, small)
    kept = {r.doc_id: r for r in first.collect()}
    assert first.columns == docs.columns and set(kept) == {i for i, s in scores.items() if s >= 0.3}
    assert all(kept[i] == rows[i] for i in kept) and 0 < len(kept) < len(rows)

    chain = line_labels.fit(docs, labels)
    want = set()
    for i, r in kept.items():
        n, _, _, _, repeated = counts_by_force(r.text)
        if n >= 50 and 100 * repeated <= 50 * n and 100 * content_by_hand(chain, r.text or "") >= 50 * n:
            want.add(i)
    second = stages["quality_rules"](spark, first, small)
    got = {r.doc_id: r for r in second.collect()}
    assert set(got) == want and all(got[i] == rows[i] for i in got) and len(want) < len(kept)

    seen, texts = {}, {}
    for i in sorted(want):
        stay = []
        for line in rows[i].text.split("\n"):
            w = tuple(WORD.findall(low(line)))
            near = len(w) >= 5 and any(within(list(w), list(s)) for n in (-1, 0, 1) for s in seen.get(len(w) + n, ()) if len(s) >= 5)
            if not w or not (w in seen.get(len(w), ()) or near):
                stay.append(line)
            seen.setdefault(len(w), set()).add(w)
        text = "\n".join(stay)
        if WORD.search(text):
            texts[i] = text
    third = stages["line_dedup"](spark, second, small)
    got = {r.doc_id: r for r in third.collect()}
    assert third.columns == docs.columns and {i: r.text for i, r in got.items()} == texts
    assert all(r.n_chars == len(r.text) for r in got.values()) and any(texts[i] != rows[i].text for i in texts)

    _, component = groups_by_force(sorted(texts.items()))
    fourth = stages["minhash_near_dedup"](spark, third, small)
    left = {r.doc_id: r.text for r in fourth.collect()}
    assert left == {i: texts[i] for i in texts if component[i] == i}

    packed = [r.asDict() for r in stages["best_fit_packing"](spark, fourth, small).collect()]
    check_packed(packed, left)


def check_packed(rows, texts):
    """Every piece of every text once, sequences without gaps, and nearly as few as there can be."""
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder.encode_special_tokens = True
    want = []
    for i, t in texts.items():
        ids = coder.encode(t, add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((i, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == [sum(x for _, x in places[:k]) for k in range(len(places))]
        assert sum(x for _, x in places) <= 2048
    assert len(sequences) <= 1.25 * -(-sum(w[3] for w in want) // 2048) + 2


def test_run(spark, small):
    """The whole pipeline is its stages one after the other."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    rows = [r.asDict() for r in corpus_pipeline.run(spark, small).collect()]
    check_packed(rows, {r.doc_id: r.text for r in docs.collect()})


def test_one_long_text_beside_short_ones():
    """Memory follows the lines, not the texts times the longest of them."""
    texts = ["\n".join(f"w{k % 7} x" for k in range(100_000))] + ["one short line"] * 10_000
    parts = {"weight": np.ones(len(line_labels.NAMES)), "bias": np.zeros(1), "step": np.eye(2), "start": np.zeros(2)}
    chain = line_labels.Chain(np.zeros(len(line_labels.NAMES)), np.ones(len(line_labels.NAMES)), parts)
    tracemalloc.start()
    counts, _ = line_labels.judge(pa.array(texts), chain)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[0][0] == 200_000 and len(counts) == 10_001 and peak < 500e6


def test_columns_with_clashing_names(spark):
    from spanworks.llm import licenses, line_dedup, near_dedup

    names = ["_score", "score", "_gone", "gone", "_doc", "_th", "th", "n_lines", "n_dropped", "licence", "path", "c0", "`odd name`", "fold"]
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, None)], "doc_id long, text string")
    docs = docs.withColumns({n.strip("`"): F.lit(n) for n in names})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    for out in (quality_model.keep_quality(docs, model), line_dedup.dedup_lines(docs), line_labels.keep_content(docs, None), near_dedup.keep_one(docs)):
        assert out.columns == docs.columns
        out.collect()
    counted = line_dedup.dedup_lines(docs, counts=True)
    assert sorted(counted.columns) == sorted(docs.columns) and {r.n_dropped for r in counted.collect()} == {0, 1}
    scanned = licenses.scan(docs)
    assert scanned.columns.count("licence") == 1 and scanned.count() == 3


def test_workers_without_the_package(data_dir, tmp_path):
    """Each operator runs where the workers have neither the working directory nor PYTHONPATH."""
    code = textwrap.dedent(f"""
        import json, sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
                 .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://{tmp_path}/scratch").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        from spanworks.llm.queries import llm_queries
        print("COUNTS", json.dumps({{n: q(spark, {data_dir!r}).count() for n, q in llm_queries().items()}}))
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    found = re.search("COUNTS (.*)", done.stdout)
    assert found, done.stderr[-2000:]
    assert len(json.loads(found[1])) >= 13 and min(json.loads(found[1]).values()) > 0
