"""Operators on texts: brute force, and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from spanworks.llm import backoff_lm, bpe, line_dedup, line_labels, near_dedup, packing, quality_model, tokens
from spanworks.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score string, fold int, th long, key string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    """Near copies, repeats, ties, nulls, empty and long texts."""
    rng = random.Random(3)
    words = ["the", "of", "énorme", "x", "Alpha", "beta.", "日本", "and", "to", "|", "###", "is", "was", "go"]
    out = ["", None, "   \n\t", "one", "One two", "one two three four", "a " * 4000, "\n".join(["same line of words here"] * 5)]
    for _ in range(12):
        base = [rng.choice(words) + str(rng.randint(0, 60)) for _ in range(rng.randint(6, 90))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.4:
                copy.insert(rng.randrange(len(copy)), "new")
            for k in range(9, len(copy), 10):
                copy[k] += "\n" if rng.random() < 0.8 else ""
            out.append(" ".join(copy).replace("\n ", "\n"))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 7, t, "a", 0, 1, "k") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[12], "b", 1, 2, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def groups_by_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if least[b] < least[a] and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    least[a], changed = least[b], True
    return sets, least


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(docs, block):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, least = groups_by_force([r for r in rows if r[0] is not None])
    got = near_dedup.near_duplicates(docs, block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(
        (i, len(shingles(t)), least.get(i), i is not None and least[i] == i) for i, t in rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i in least if least[i] == i}


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        common = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        extra = rng.integers(0, 2**64, (2, int(4000 * (1 / share - 1) / 2)), dtype=np.uint64)
        cells = near_dedup.registers([np.concatenate([common, e]) for e in extra])
        same = ((cells[0] == cells[1]) & (cells[0] > 0)).mean()
        assert abs(same - share) < 0.08
        assert (near_dedup.band_keys(cells[:1]) == near_dedup.band_keys(cells[1:])).any() or share < 0.75
    assert near_dedup.registers([np.zeros(0, np.uint64)]).max() == 0


def test_groups_that_only_blocks_find(spark):
    """Members that link to a middle one but not to the least of the band."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[4 * k : 4 * k + 120])) for k in range(20)]
    _, least = groups_by_force(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert {r.doc_id: r.component_id for r in got} == least
    assert set(least.values()) == {0}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    least = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: c for n, c in least.items() if any(n in p and p[0] != p[1] for p in pairs)}


def within(a, b):
    table = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, table[0] = table[0], i
        for j, y in enumerate(b, 1):
            last, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, last + (x != y))
    return table[-1] <= 1


def test_one_edit():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in "12")
        assert line_dedup.within_one_edit(a, b) == within(a, b)


def test_line_dedup(docs):
    """Near repeats, where short lines are left alone; equal short lines have a test of their own."""
    seen, expected = [], {}
    for i, t in sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.text is not None}):
        kept = []
        for line in t.split("\n"):
            w = WORD.findall(low(line))
            if len(w) < 5 or not any(within(w, s) for s in seen):
                kept.append(line)
            if len(w) >= 5:
                seen.append(w)
        expected[i] = "\n".join(kept)
    out = line_dedup.dedup_lines(docs, exact_words=line_dedup.MIN_WORDS)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got if r.doc_id is not None) == Counter(
        (r.doc_id, None if r.text is None else expected[r.doc_id]) for r in docs.collect() if r.doc_id is not None)
    assert sorted(r.text or "" for r in got if r.doc_id is None) == sorted(r.text or "" for r in docs.where("doc_id is null").collect())


def test_short_lines_that_repeat(spark, docs):
    """With ``exact_words``, short lines go only if equal to an earlier one; the pipeline takes out those of one word."""
    for words in (1, 3):
        seen, expected = [], {}
        for i, t in sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.text is not None}):
            kept = []
            for line in t.split("\n"):
                w = WORD.findall(low(line))
                if len(w) < words or not (w in seen or (len(w) >= 5 and any(len(s) >= 5 and within(w, s) for s in seen))):
                    kept.append(line)
                seen.append(w)
            expected[i] = "\n".join(kept)
        got = line_dedup.dedup_lines(docs, exact_words=words).where("doc_id is not null and text is not null").collect()
        assert {r.doc_id: r.text for r in got} == expected
    rows = [(1, "All rights reserved.\nfirst"), (2, "ALL rights reserved.\nsecond one"), (3, "all rights  reserved.\nFirst"), (4, "rights reserved.")]
    short = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, short, "").collect()}
    assert got == {1: rows[0][1], 2: "second one", 4: "rights reserved."}


def test_training_lines_of_long_texts(spark):
    """The lines learnt from are a run anywhere in the text, its end included, and all of a short one."""
    texts = [(k, 1, "\n".join(f"{'x' * (n + 1)} y" for n in range(100 if k else 5))) for k in range(60)]
    rows = spark.createDataFrame(texts, "doc_id long, quality int, text string").mapInArrow(
        line_labels._line_rows, "doc_id long, quality int, lines binary, hashes binary").collect()
    whole = {n: np.frombuffer(r.lines, "<f4").reshape(-1, len(line_labels.NAMES)) for n, r in ((r.doc_id, r) for r in rows)}
    assert len(whole[0]) == 5 and {len(v) for k, v in whole.items() if k} == {line_labels.SAMPLE_LINES}
    assert len({v.tobytes() for k, v in whole.items() if k}) > 10
    places = {line_labels.place_of_run(k, 100) for k in range(2000)}
    assert places == set(range(100 - line_labels.SAMPLE_LINES + 1))


def test_the_chain_switches_within_a_text():
    """Lines that many sampled texts share are learnt as boilerplate, and found in a good text that holds them."""
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(3, 9) for _ in range(9)) + "."
    notices = ["CLICK HERE!!! $$$ | Subscribe | Log in | FREE", "Cookies | Privacy | Terms | © 2020 ####"]
    texts = [([line() for _ in range(6)], 1) for _ in range(60)] + [([f"BUY $$$ {k} | NOW!!! ####" for k in range(6)], 0) for _ in range(40)]
    for k, (lines, _) in enumerate(texts[:40]):
        lines.insert(rng.randint(0, len(lines)), notices[k % 2])
    sets, hashes = [], []
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(len(texts)), pa.int64()), pa.array([y for _, y in texts], pa.int32()), pa.array(["\n".join(x) for x, _ in texts])],
        names=["doc_id", "quality", "text"])
    for out in line_labels._line_rows(iter([batch])):
        sets = [np.frombuffer(x, "<f4").reshape(-1, len(line_labels.NAMES)) for x in out.column(2).to_pylist()]
        hashes = [np.frombuffer(x, "<u8") for x in out.column(3).to_pylist()]
    labels = np.array([y for _, y in texts])
    states = line_labels.weak_labels(hashes, labels)
    assert [s.tolist() for s in states] == [[0.0 if x in notices else float(y) for x in lines] for lines, y in texts]
    chain = line_labels.fit_chain(sets, labels, states)
    mixed = [line() for _ in range(4)] + [notices[0]] + [line() for _ in range(4)]
    counts, content = line_labels.judge(pa.array(["\n".join(mixed)]), chain)
    assert content[0] == counts[0][0] - len(notices[0].split())
    alone = line_labels.fit_chain(sets, labels)
    assert alone.parts["step"][1, 0] < chain.parts["step"][1, 0]


def counts_by_force(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)]


def test_line_counts(texts):
    rng = random.Random(7)
    some = texts + ["".join(rng.choice(["a", "b", " ", "\n", "é", "|", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    counts, content = line_labels.judge(pa.array(some, pa.string()), None)
    assert counts.tolist() == [counts_by_force(t) for t in some]
    assert content.tolist() == counts[:, 0].tolist()


def test_viterbi_and_gradients():
    rng = np.random.default_rng(2)
    parts = {"weight": rng.normal(size=3), "bias": rng.normal(size=1), "step": rng.normal(size=(2, 2)), "start": rng.normal(size=2)}
    chain = line_labels.Chain(np.zeros(3), np.ones(3), parts)
    first = np.array([0, 4, 4, 5, 11])
    rows, states = rng.normal(size=(11, 3)), rng.integers(0, 2, 11).astype(float)

    def score(x, path):
        e = chain.emissions(x)
        return parts["start"][path[0]] + sum(e[k, s] for k, s in enumerate(path)) + sum(parts["step"][a, b] for a, b in zip(path, path[1:]))

    def paths(n):
        return [[m >> k & 1 for k in range(n)] for m in range(2**n)]

    got = chain.decode(rows, first)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert got[a:b].tolist() == max(paths(b - a), key=lambda p: score(rows[a:b], p))

    def loss():
        whole = [(a, b) for a, b in zip(full[:-1], full[1:])]
        return -np.mean([
            score(rows[a:b], states[a:b].astype(int).tolist()) - np.log(sum(np.exp(score(rows[a:b], p)) for p in paths(b - a))) for a, b in whole])

    full = np.array([0, 4, 5, 11])
    slopes = chain.gradients(rows, full, states)
    for name, value in parts.items():
        flat = value.reshape(-1)
        for k in range(len(flat)):
            flat[k] += 1e-5
            up = loss()
            flat[k] -= 2e-5
            down = loss()
            flat[k] += 1e-5
            assert abs((up - down) / 2e-5 - slopes[name].reshape(-1)[k]) < 1e-5


def test_attention_gradients():
    rng = np.random.default_rng(5)
    bags = [rng.normal(size=(n, 4)) for n in (1, 3, 2)]
    labels = np.array([0.0, 1.0, 1.0])
    model = quality_model.fit_attention(bags, labels)
    rows, sizes = np.concatenate(bags), np.array([1, 3, 2])

    def loss():
        s = model.scores(rows, sizes)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    for name, slope in model.gradients(rows, sizes, labels).items():
        flat = model.parts[name].reshape(-1)
        for k in range(0, len(flat), 3):
            flat[k] += 1e-5
            up = loss()
            flat[k] -= 2e-5
            down = loss()
            flat[k] += 1e-5
            assert abs((up - down) / 2e-5 - slope.reshape(-1)[k]) < 1e-4


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.predictions(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    chain = line_labels.fit(docs, labels)
    kept = {r.doc_id: r.kept for r in line_labels.verdicts(docs, chain).collect()}
    clean = [kept[r.doc_id] for r in labels.where("quality = 1").collect()]
    junk = [kept[r.doc_id] for r in labels.where("quality = 0").collect()]
    assert np.mean(clean) > 0.9 and np.mean(junk) < 0.1


def test_quality_of_odd_rows(spark, docs, empty):
    some = spark.createDataFrame([(7, 1), (14, 0), (None, 1), (21, None), (49, 0), (56, 1)], "doc_id long, quality int")
    for labels in (some, some.limit(0)):
        rows = quality_model.predictions(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality_model.keep_quality(docs, quality_model.fit(docs, labels)).columns == docs.columns
        chain = line_labels.fit(docs, labels)
        assert line_labels.keep_content(docs, chain).columns == docs.columns
        assert line_labels.verdicts(docs, chain).count() == docs.count()
    assert quality_model.predictions(empty, some).count() == 0
    assert line_labels.verdicts(empty, line_labels.fit(empty, some)).count() == 0


def lm_by_force(rows, order, strength):
    texts = [(i, zlib.crc32(str(i).encode()) % 10 if i is not None else -1, WORD.findall(low(t)) + [""]) for i, t in rows]
    counts, after = Counter(), Counter()
    for _, fold, w in texts:
        x = ["<start>"] + w
        for k in range(1, order + 1):
            for end in range(1, len(x)):
                if fold > 0 and end - k + 1 >= 0:
                    counts[tuple(x[end - k + 1 : end + 1])] += 1
                    after[tuple(x[end - k + 1 : end])] += 1
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(1 for g in counts if len(g) == 1)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.1) / (total + 0.1 * (distinct + 1))
        return (counts[gram] + strength * p(gram[1:])) / (after[gram[:-1]] + strength)

    for i, fold, w in texts:
        x = ["<start>"] + w
        yield (
            i, fold == 0, len(w), sum(counts[(t,)] > 0 for t in w), total, sum(np.log10(p((t,))) for t in w),
            sum(np.log10(p(tuple(x[max(0, e - order + 1) : e + 1]))) for e in range(1, len(x))))


@pytest.mark.parametrize("order,block,ranges", [(2, 300, 100), (3, 1000, 10**6), (1, 10**6, 50)])
def test_backoff_lm(docs, order, block, ranges):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    expected = sorted(lm_by_force(rows, order, 5.0), key=key)
    got = sorted((tuple(r) for r in backoff_lm.score(docs, order, 5.0, block, ranges).collect()), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_walks_agree(texts, order, monkeypatch):
    """Texts walked alone, side by side, and by the formula; with few n-grams known, so that states are missing."""
    rng = np.random.default_rng(4)
    grams = backoff_lm.grams_of(pa.array([t or "" for t in texts]), order)
    counts = [rng.integers(0, 3, len(k)) * rng.integers(0, 2, len(k)) for k in grams.keys]
    for k in range(1, order):  # a seen n-gram has a seen context and ending
        at = np.flatnonzero((grams.place[k] >= 0) & (grams.place[k - 1] >= 0))
        seen = at[counts[k][grams.place[k][at]] > 0]
        counts[k - 1][grams.place[k - 1][seen]] += 1
        real = seen[grams.place[k - 1][seen - 1] >= 0]
        counts[k - 1][grams.place[k - 1][real - 1]] += 3
    automaton = backoff_lm.Automaton.build(grams, counts, 100, 20, 5.0)
    walks = []
    for long in (0, 20, 10**6):
        monkeypatch.setattr(backoff_lm, "LONG", long)
        walks.append(automaton.walk())
    assert np.allclose(walks[0], walks[1]) and np.allclose(walks[0], walks[2]) and len(walks[0]) == len(texts)


def test_packed_counts():
    for some in ([], [0], [254, 255, 256, 0, 10**12], [255] * 3):
        assert backoff_lm.unpack_counts(backoff_lm.pack_counts(np.array(some, np.int64)), len(some)).tolist() == some


def test_packed_keys():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (backoff_lm.unpack_keys(backoff_lm.pack_keys(keys)) == keys).all()


ODD = ["", "  ", "x  y", "\n\n a", " \xa0 a", "don't I'll 'S", "á b", "=====  ==== aaa", "日本語 😀😀 é", "tail  ", " \x1c a",
       "<|endoftext|> x", "ΑΣ ΑΣ. Σ", "12 345  6\t7 \n", "(''s 'll)", "a1b2", "x'sy", "İstanbul ŉ"]


def test_bpe(spark, texts):
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "=", "é", "\xa0", "1", "the", "'s", "😀", "\t", "́", "ing", "\x85", "!", "("]
    some = [t or "" for t in texts] + ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    path = bpe.default_path()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    coded = bpe.encode(df, spans=True)
    rows = {r.doc_id: r for r in coded.collect()}
    for i, text in enumerate(some):
        ids = encoding.encode_ordinary(text)
        assert rows[i].ids == ids
        spans = list(zip(rows[i].begins, rows[i].ends))
        assert all(0 <= a < b <= len(text) for a, b in spans)
        assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == dict(enumerate(some))
    for r in bpe.digests(df).collect():
        ids = np.array(rows[r.doc_id].ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(some[r.doc_id].encode()).hexdigest()


def test_bpe_of_null_and_split_characters(spark, empty):
    df = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {r.n_tokens for r in bpe.digests(df).collect()} == {0}
    assert bpe.digests(empty).count() == 0
    path = bpe.default_path()
    half = bpe.read_ranks(path)["é".encode()[:1]]
    cut = spark.createDataFrame([(1, [half]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(cut).collect()} == {1: "�", 2: ""}


def test_word_tokens_equal_the_whole_tokenizer(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    some = [t or "" for t in texts] + ODD
    got = list(tokens.column_ids(pa.array(some), tokens.Coder(tokens.load(path), packing.SPLIT, True)))
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("most_open,share", [(3, 10), (2048, 10**6)])
def test_packing(docs, most_open, share):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = 64
    rows = packing.pack(docs, length=length, most_open=most_open, share=share).collect()
    expected = Counter()
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), length)):
            part = ids[a : a + length]
            expected[(r.doc_id, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length


def test_best_fit():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 4, 3, 10, 5, 6, 9, 1)] == [
        (0, 0), (1, 0), (0, 6), (1, 7), (2, 0), (3, 0), (4, 0), (5, 0), (4, 6)]


def test_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert backoff_lm.score(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"word{k % 5000} x{k}" for k in range(300_000)) + "z" * 200_000
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one here")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert [r.n_tokens for r in backoff_lm.score(df).orderBy("doc_id").collect()] == [600_001, 600_002, 4]
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert cleaned[1] == text and cleaned[2] == ""
