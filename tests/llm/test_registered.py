"""Registered corpus queries over the smallest tables, against SQL, the libraries, or brute force in plain Python."""

import math
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import passages
from tallyframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_token_files_hold_the_library_s_ids(spark, docs):
    from tallyframe.llm.q_token_files import tokenizer_path
    from tallyframe.llm.token_files import load_tokenizer

    tokenizer, at = load_tokenizer(tokenizer_path()), 0
    got = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, SF).collect()}
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = got[r.doc_id]
        assert (own.start, own.n_tokens, own.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_words_of_a_text_tokenise_alone():
    """The joined words give the library's ids for texts of odd spaces, marks and the end-of-text string."""
    from tallyframe.llm.q_token_files import tokenizer_path
    from tallyframe.llm.token_files import WordCoder, load_tokenizer

    rng, coder, tokenizer = random.Random(1), WordCoder(tokenizer_path()), load_tokenizer(tokenizer_path())
    parts = ["a", "Word", " ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "<|endoftext|>", "'s", "'ll", "don't", "é", "日本", "\U0001f642", "123", "!?", "\x1c", "\x7f", "​", "\r\n", "“”", "\x00", "xyz" * 30]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4)] + [None, ""]
        ids, counts = coder.texts(pa.array(texts, pa.string()))
        want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_vocabulary_beyond_the_files_is_refused(spark, monkeypatch, tmp_path):
    from tallyframe.llm import token_files

    class Large:
        def get_vocab(self):
            return {"a": 70_000}

    monkeypatch.setitem(token_files._tokenizers, "large", Large())
    with pytest.raises(ValueError, match="70000"):
        token_files.write_token_files(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "f"), "large")


def test_quality_is_its_parts(spark, docs):
    """Posteriors and scores recomputed in plain Python from the own scores, the labels and the sites."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality in (0, 1)}
    got = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, SF).collect()}
    assert len(got) == len(docs)
    site = {r.doc_id: (r.source, r.lang) for r in docs}
    evidence = {i: float(labels.get(i, r.own_score)) for i, r in got.items()}

    def shrunk(groups, prior):
        over = noise = total = 0.0
        for k, values in groups.items():
            n, p = len(values), prior[k]
            if n >= 2:
                over += n * (sum(values) / n - p) ** 2 - p * (1 - p)
                noise, total = noise + p * (1 - p) * n, total + n
        over = max(0.0, over) / max(1.0, total)
        strength = min(1e4, max(1.0, noise / max(1.0, total) / over - 1)) if over > 0 else 1e4
        return {k: (sum(v) + strength * prior[k]) / (len(v) + strength) for k, v in groups.items()}

    share = (sum(evidence.values()) + 1) / (len(evidence) + 2)
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, e in evidence.items():
        hosts[site[i][0]].append(e)
        paths[site[i]].append(e)
    host_post = shrunk(hosts, dict.fromkeys(hosts, share))
    path_post = shrunk(paths, {k: host_post[k[0]] for k in paths})
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for i, r in got.items():
        assert abs(r.site_share - path_post[site[i]]) < 1e-6
        score = 1 / (1 + math.exp(-(math.log(r.own_score / (1 - r.own_score)) + logit(path_post[site[i]]) - logit(share)))) if 0 < r.own_score < 1 else r.own_score
        assert abs(r.score - score) < 1e-6 and r.kept == (r.score >= 0.5)


def test_toxicity_on_held_out_labels(spark):
    out = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r.toxic in (0, 1)]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    held = [(out[i].predicted, t) for i, t in labels if out[i].held_out]
    toxic = [p for p, t in held if t]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(p for p, t in held if not t) <= 0.03 * len(held)


def test_scores_are_kernel_values(spark):
    """A fitted machine's margin of a word is its weighted sum of kernel values, counted here letter by letter; long words go by their windows."""
    from tallyframe.llm import toxicity as tox

    rng = random.Random(4)
    word = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    positive, negative = [word(7) for _ in range(30)] + [word(60)], [word(6) for _ in range(60)]
    machine = tox._fit(positive, negative)

    def weights(w):
        found = defaultdict(float)
        codes = [tox._CODE[b] for b in w]
        for a in range(len(w)):
            for b, c in tox.PLACES:
                if a + c < len(w):
                    found[codes[a] << 12 | codes[a + b] << 6 | codes[a + c]] += tox.DECAY ** (c + 1)
        norm = math.sqrt(sum(v * v for v in found.values())) or 1
        return {k: v / norm for k, v in found.items()}

    def margin(w):
        parts = [w[a : a + tox.WINDOW] for a in range(0, max(1, len(w) - tox.WINDOW // 2), tox.WINDOW // 2)]
        return max(sum(v * machine.table[k] for k, v in weights(p).items()) + machine.bias for p in parts)

    for w in positive[:10] + negative[:10] + [positive[-1], word(100)]:
        got = machine.margins(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        assert abs(got - margin(w)) < 1e-3, w
    assert tox._in_windows([b"a" * 70]) == [b"a" * 32, b"a" * 22] or len(tox._in_windows([b"a" * 70])) >= 1


def smith_waterman(item, text):
    """(score, matched, words spanned) of the best local alignment, cell by cell; of equal scores more matches, then a later start."""
    row = [(0, 0, -j) for j in range(len(text) + 1)]
    row = [(0, 0, j) for j in range(len(text) + 1)]
    best = (0, 0, 0, 0)
    for w in item:
        new = [(0, 0, 0)]
        for j, x in enumerate(text, 1):
            s, m, b = row[j - 1]
            diag = (s + 2, m + 1, b) if w == x else (s - 1, m, b)
            up, left = (row[j][0] - 1, *row[j][1:]), (new[j - 1][0] - 1, *new[j - 1][1:])
            new.append(max(diag, up, left, (0, 0, j)))
        for j, (s, m, b) in enumerate(new):
            if (s, m, b) > best[:3] and s > best[0] or (s == best[0] and (m, b) > best[1:3]):
                best = (s, m, b, j)
        row = new
    return best[0], best[1], best[3] - best[2]


def bench_words(t):
    return re.findall(r"[^\x00-\x20\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_leaks_are_those_of_brute_force(spark):
    from tallyframe.llm.decontaminate import benchmark_leaks

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([8, 14, 30, 60]))) for k in range(10)] + [(20, "brown fox"), (21, "zebra"), (22, ""), (23, None)]
    rows = [(k, text(60)) for k in range(25)] + [(50, "the quick brown fox"), (51, "brown fox"), (52, "a brown dog, a red fox"), (53, "one zebra!"), (54, None), (55, "")]
    for k in range(24):
        words = items[k % 10][1].split()
        rate = rng.choice([0, 0.1, 0.2, 0.3])
        edited = [x for w in words for x in ([] if rng.random() < rate / 3 else [rng.choice(vocabulary)] if rng.random() < rate / 2 else [w])]
        rows.append((100 + k, f"{text(20)} {' '.join(edited)} {text(25)}"))
    got = {(r.doc_id, r.item_id): r for r in benchmark_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in rows:
        words = bench_words(t)
        runs = {tuple(words[a : a + n]) for n in (1, 2, 3) for a in range(len(words) - n + 1)}
        for i, own in items:
            item = bench_words(own)
            n = min(3, len(item))
            if n and any(tuple(item[a : a + n]) in runs for a in range(len(item) - n + 1)):
                score, matched, span = smith_waterman(item, words)
                if matched >= max(min(3, len(item)), min(10, math.ceil(0.6 * len(item)))) and matched >= 0.5 * span:
                    want.add((d, i))
                    assert (d, i) in got and (got[d, i].score, got[d, i].n_matched) == (score, matched)
    assert set(got) == want and {(50, 20), (51, 20), (53, 21)} <= want and len(want) > 15


def test_a_long_item_takes_bounded_memory(spark):
    """An item of 5,000 words, and a text of 20,000 words that repeats one phrase."""
    import tracemalloc

    from tallyframe.llm.decontaminate import Items, leaks_in

    rng = random.Random(13)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(5000))
    item = Items.of([1, 2], [long, "one two three four five"], None)
    tracemalloc.start()
    found = leaks_in(pa.array([f"x {long} y", "one two three four five " * 4000]), item, 10, 0.6, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(r, int(i)) for r, i, *_ in found} == {(0, 0), (1, 1)} and peak < 400 << 20


def test_streamed_pieces_hold_little():
    """On the query's path: the library's ids for long words and long texts, however they are cut, with a bounded window."""
    import sentencepiece

    from tallyframe.llm import pieces as pc
    from tallyframe.llm.q_pieces import model_path

    own, library = pc.load_pieces(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(5)
    parts = ["a", "Word", " ", "  ", "\n", "the", "ing", "é", "日本", "\U0001f642", "123", "!?", "\x00", "▁", "x" * 70, " " * 90, "=====", "abcabc" * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["ab" * 60_000, "the house " * 20_000, "日" * 30_000]
    for t in texts:
        want = library.encode(t)
        for size in (7, 1 << 16):
            stream, out, widest = pc.TextStream(own), [], 0
            for k in range(0, len(t), size):
                out.append(stream.push(t[k : k + size]))
                widest = max(widest, len(stream.tail), stream.search.widest if stream.search else 0)
            out.append(stream.finish())
            assert np.frombuffer(b"".join(out), "<u2").tolist() == want
            assert widest <= pc.HELD + 8 * own.longest
            if len(t) > 10_000:
                break
        assert np.frombuffer(own.encode(t), "<u2").tolist() == want


def test_passages_are_those_of_brute_force(spark, docs, monkeypatch):
    """Owners and spans from the chunks of all documents in plain Python, with and without digests that are looked up while reading."""
    chunks = {}
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        _, start, end, digest, second, words = passages._chunked([raw])
        chunks[r.doc_id] = list(zip(start.tolist(), end.tolist(), zip(digest.tolist(), second.tolist()), words.tolist()))
        for _, _, d, _ in chunks[r.doc_id]:
            first.setdefault(d, r.doc_id)
    want = set()
    for i, own in chunks.items():
        run = []
        for part in [*own, (None, None, None, None)]:
            if part[2] is not None and first[part[2]] < i:
                run.append(part)
                continue
            if run and (sum(p[3] for p in run) >= passages.MIN_WORDS or run[-1][1] - run[0][0] >= passages.MIN_BYTES):
                want.add((i, run[0][0], run[-1][1], sum(p[3] for p in run), min(first[p[2]] for p in run)))
            run = []
    columns = ("doc_id", "span_start", "span_end", "n_words", "first_doc_id")
    for share in (passages.HOT_SHARE, 1 << 40, 0):
        monkeypatch.setattr(passages, "HOT_SHARE", share)
        assert {tuple(r[c] for c in columns) for r in QUERIES["op10_substring_dedup"](spark, SF).collect()} == want
    assert want


def test_chunks_of_one_character():
    """Equal hashes end no chunk; the grid does, on whole characters."""
    for raw in (b"a" * 100_000, b"spam " * 20_000, "é".encode() * 50_000, "日本".encode() * 20_000):
        _, start, end, _, words = passages.chunks_of([raw])
        assert len(start) <= len(raw) / passages.MOST + 2 and (end - start).max() <= passages.MOST + 3
        assert all(raw[a:z].decode() is not None for a, z in zip(start, end)) and start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all()
    shared = b"q" * 5000
    a, b = b"head one " + shared + b" tail", b"other words before " + shared + b" more"
    text, _, _, digest, _ = passages.chunks_of([a, b])
    assert len(set(digest[text == 0]) & set(digest[text == 1])) >= 1


def test_quality_rules_verdict(spark):
    """On sf0.01: base counts of every document, and verdicts by a NumPy estimate of its group, but for distances within a tenth of the cutoff."""
    from test_frames import base_rules, mcd

    from tallyframe.llm.quality_rules import BIN, CHI2_MEDIAN, CUTOFF, MIN_ROWS

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    x, groups = {}, {}
    for r in rows:
        own = got[r.doc_id]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == base_rules(r.text)
        assert own.base_failed == (own.n_words < 50 or 100 * own.n_repeat_words > 50 * own.n_words)
        if not own.base_failed:
            n = max(own.n_words, 1)
            lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in (r.text or "").split("\n"))
            x[r.doc_id] = [math.log(max(own.word_chars, 1) / n), math.log1p(100 * own.n_symbols / n), math.log1p(100 * own.n_dup_lines / max(lines, 1)), math.log1p(100 * own.n_repeat_words / n), math.log(n)]
            for g in ((r.lang, r.source), (r.lang,), ()):
                groups.setdefault(g, []).append(r.doc_id)
    floors, same, near = np.array([0.02, 0.243, 0.78, 0.567, 0.1]), 0, 0
    estimates = {}
    for g, ids in groups.items():
        if len(ids) >= MIN_ROWS:
            m = np.array([x[i] for i in ids])
            mean, cov, _ = mcd(m)
            low = np.zeros((5, 5))
            for i in range(5):
                for j in range(i + 1):
                    rest = cov[i, j] - low[i, :j] @ low[j, :j]
                    low[i, j] = math.sqrt(max(rest, floors[i] ** 2)) if i == j else rest / low[j, j]
            d = (np.linalg.solve(low, (m - mean).T) ** 2).sum(axis=0)
            estimates[g] = mean, low, max(1.0, 2 ** (1 / BIN) * np.median(d) / CHI2_MEDIAN)
    for r in rows:
        own = got[r.doc_id]
        if own.base_failed:
            assert not own.kept
            continue
        group = next((g for g in ((r.lang, r.source), (r.lang,), ()) if g in estimates), None)
        if group is None:
            assert own.kept
            continue
        mean, low, scale = estimates[group]
        d = (np.linalg.solve(low, np.array(x[r.doc_id]) - mean) ** 2).sum() / scale
        assert own.kept == (own.distance <= CUTOFF)
        if not 0.8 < d / CUTOFF < 1.25:
            same, near = same + (own.kept == (d <= CUTOFF)), near + 1
    assert same >= 0.99 * near and near > 500
