"""Corpus operators on DataFrames: edge cases, small brute-force comparisons, planted cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm.chat_frames import digests, format_conversations
from tallyframe.llm.decontaminate import benchmark_leaks, without_leaks
from tallyframe.llm.passages import repeated_passages, without_repeats
from tallyframe.llm.pieces import decode_ids, encode_texts
from tallyframe.llm.q_chat import TEMPLATE
from tallyframe.llm.q_pieces import model_path
from tallyframe.llm.q_token_files import tokenizer_path
from tallyframe.llm.quality import keep_quality, quality_scores
from tallyframe.llm.quality_rules import quality_rules
from tallyframe.llm.token_files import read_token_files, write_token_files
from tallyframe.llm.toxicity import fit_toxicity, toxicity
from tallyframe.llm.urls import judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ("id", "digest", "score", "cuts", "own", "grp", "site_share", "rule", "ids", "post")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def words(rng, n, size=4000):
    return " ".join("".join(chr(97 + (rng.randrange(size) * 7 + k * k) % 26) for k in range(2 + rng.randrange(7))) for _ in range(n))


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, null and repeated ids, clashing columns."""
    rng = random.Random(0)
    rows = [(None, None), (None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, words(rng, 60_000)), (6, "same text here"), (6, "same text here"), (6, "other text"), (7, "same text here"), (8, "é一\U0001f600 " * 20)]
    rows += [(10 + k, words(rng, 80)) for k in range(20)]
    return clashing(docs_frame(spark, rows)).cache()


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.org"), (2, None), (3, "x"), (4, "https://a.com/de/q?x=/fr/"), (4, "https://a.com/de/q?x=/fr/"), (5, "ftp://u@H.COM:80/fr/")], "page_id long, url string").withColumn("rule", F.lit("mine"))
    rules = [("allow", "org/"), ("block", "com/de/"), ("allow", "com:80/fr/")]
    want = [(1, "a.org", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.com", "/de/q", "com/de/", "block"), (4, "a.com", "/de/q", "com/de/", "block"), (5, "u@h.com:80", "/fr/", "com:80/fr/", "allow")]
    for limit in (100, 1):  # a trie, and the join that stands in for it
        given = rules if limit > 1 else spark.createDataFrame(rules, "verdict string, rule string")
        out = judge_urls(pages, given, max_rules=limit).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    long = spark.createDataFrame([(1, "http://" + "a." * 400 + "org/" + "x/" * 5000)], "page_id long, url string")
    odd = [*rules, ("allow", None), ("maybe", ""), (None, None), ("block", "com/de/"), ("allow", "com/de/")]
    for limit in (100, 1):
        given = spark.createDataFrame(odd, "verdict string, rule string")
        out = judge_urls(pages.unionByName(long, allowMissingColumns=True), given, max_rules=limit).select("page_id", "rule", "verdict").collect()
        assert sorted(map(tuple, out), key=str) == sorted([(i, r, v) for i, _, _, r, v in want] + [(1, "org/", "allow")], key=str)
        with pytest.raises(ValueError):
            judge_urls(pages, given.unionByName(spark.createDataFrame([("deny", "org/")], "verdict string, rule string")), max_rules=limit)
    listed = judge_urls(pages, rules, max_rules=1).select("page_id", "host", "path", "rule", "verdict").collect()  # a list is held to the bound too
    assert sorted(map(tuple, listed), key=str) == sorted(want, key=str)
    assert judge_urls(pages.limit(0), rules).count() == 0 and judge_urls(pages, [], default="block").where("verdict = 'block'").count() == 6


def test_chat(spark):
    rng = random.Random(1)
    bits = ["</s>", "[INST]", "\\", "\n", "é", "text ", "[/INST] "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for c in (1, 2, None) for t in range(40)] + [(2, 0, "user", "tie"), (2, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(9)).repartition(7)
    got = {r.conv_id: r for r in digests(format_conversations(frame, TEMPLATE)).collect()}
    for c in (1, 2, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert digests(format_conversations(frame.limit(0), TEMPLATE)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    from tallyframe.llm import chat_frames

    parts = list(chat_frames._parts(1, chat_frames.compile_template(TEMPLATE)({"role": "user", "text": "x" * 400_000} for _ in range(9))))
    assert [p[1] for p in parts] == list(range(len(parts))) and len(parts) == 3 and all(p[2].endswith("</s>") for p in parts)


def test_pieces_frames(spark, odd):
    out = encode_texts(odd, model_path(), check_col="ok")
    assert out.columns == [*(c for c in odd.columns if c != "ids"), "ids", "ok"] and out.where("not ok").count() == 0 and out.count() == odd.count()
    back = decode_ids(out.select("doc_id", "ids", F.col("text").alias("was")), model_path())
    assert back.where("text <> coalesce(was, '')").count() == 0
    assert encode_texts(odd.limit(0), model_path()).count() == 0


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    write_token_files(odd, str(tmp_path / "files"), tokenizer_path(), shards=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, str(tmp_path / "files")).collect())
    tokenizer, want, at = Tokenizer.from_file(tokenizer_path()), {}, 0
    for r in odd.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda i: (i is not None, i or 0))
    for start, doc, n, crc in got:
        assert start == at and (n, crc) in want[doc]
        want[doc].remove((n, crc))
        at += n
    assert not any(want.values())
    write_token_files(odd.limit(0), str(tmp_path / "none"), tokenizer_path())
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_leaks(spark, odd):
    rng = random.Random(5)
    items = [(k, words(rng, 30)) for k in range(6)] + [(90, None), (91, ""), (92, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = lambda t, every: " ".join(w if k % every else "zzz" for k, w in enumerate(t.split(), 1))
    planted = {100: items[0][1].upper(), 101: edited(items[1][1], 6), 102: edited(items[2][1], 4), 103: " ".join(items[3][1].split()[5:24])}
    rows = [(i, words(rng, 50) + " -- " + t.replace(" ", ", ") + ". " + words(rng, 40)) for i, t in planted.items()] + [(110 + k, " ".join(items[4][1].split()[:4]) + " " + words(rng, 50)) for k in range(4)]
    docs = clashing(odd.drop(*CLASHES).unionByName(docs_frame(spark, rows)))
    hits = benchmark_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(100, 0), (101, 1), (102, 2), (103, 3)}
    sliced = benchmark_leaks(docs, bench, slice_bytes=200).collect()
    assert {(r.doc_id, r.item_id) for r in sliced} == {(r.doc_id, r.item_id) for r in hits}
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert benchmark_leaks(docs.limit(0), bench).count() == 0 and benchmark_leaks(docs, bench.limit(0)).count() == 0 and without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_passages(spark, odd):
    rng = random.Random(6)
    shared = [words(rng, 51), words(rng, 120)]
    short = words(rng, 10)
    rows = [(200 + k, f"{words(rng, 40)}\n{shared[k % 2]} {words(rng, 30)} {short} {words(rng, 5)}") for k in range(6)]
    docs = clashing(odd.drop(*CLASHES).unionByName(docs_frame(spark, rows)))
    spans = repeated_passages(docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in spans if r.doc_id >= 200} == {(202, 200), (204, 200), (203, 201), (205, 201)}
    texts = dict(rows)
    for r in spans:
        if r.doc_id >= 200:
            piece = texts[r.doc_id].encode()[r.span_start : r.span_end].decode()
            assert piece in shared[r.doc_id % 2] or len(piece) < len(shared[r.doc_id % 2]) + 80
    out = without_repeats(docs)
    assert out.columns == docs.columns
    after = {r.doc_id: r.text for r in out.where("doc_id >= 200").collect()}
    assert after[200] == texts[200] and all(short in t for t in after.values()) and all(len(after[i]) < len(texts[i]) - 150 for i in (202, 203, 204, 205))
    clean = {r.doc_id: r.text for r in out.where("doc_id between 10 and 29").collect()}
    assert clean == {r.doc_id: r.text for r in docs.where("doc_id between 10 and 29").collect()}
    assert repeated_passages(docs.limit(0)).count() == 0 and without_repeats(docs.limit(0)).count() == 0


def test_copies_of_a_document_go_whole(spark):
    text = words(random.Random(9), 70)
    docs = docs_frame(spark, [(3, text), (1, text), (2, text), (4, "other words entirely")])
    assert sorted(r.doc_id for r in without_repeats(docs).collect()) == [1, 4]


def junk(rng, k):
    return [" ".join(["Spam"] * 80), words(rng, 80).upper().replace(" ", "!! ") + "!!", words(rng, 80).replace(" ", "### ") + "***"][k % 3]


def test_quality(spark, odd):
    rng = random.Random(7)
    rows = [(1000 + k, junk(rng, k) if k % 4 == 0 else words(rng, 60 + k % 50)) for k in range(400)]
    docs = clashing(odd.drop(*CLASHES).unionByName(docs_frame(spark, rows)))
    labels = spark.createDataFrame([(i, int((i - 1000) % 4 != 0)) for i, _ in rows if i // 7 % 3] + [(None, 1), (1001, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_scores(docs, labels).where("doc_id >= 1000").collect()}
    held = [i for i, _ in rows if i // 7 % 3 == 0]
    assert all(out[i].kept == ((i - 1000) % 4 != 0) for i in held)
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id >= 1000").collect()} == {i for i, r in out.items() if r.kept}
    assert quality_scores(docs, labels.limit(0)).where("not kept").count() == 0 and quality_scores(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    from tallyframe.llm.quality import _shrunk

    sites = spark.createDataFrame([("big", 1000, 900.0), ("bad", 1000, 100.0), ("tiny", 1, 0.0)], "host string, n long, good double")
    post = {r.host: r.post for r in _shrunk(sites, F.lit(0.5)).collect()}
    assert abs(post["big"] - 0.9) < 0.01 and abs(post["bad"] - 0.1) < 0.01 and 0.1 < post["tiny"] < 0.5


def test_toxicity(spark, odd):
    rng = random.Random(8)
    bad = ["idiot", "worthless", "scum", "moron"]
    rows = []
    for k in range(300):
        t = words(rng, 40).split()
        if k % 5 == 0:
            t.insert(rng.randrange(40), bad[k // 5 % 4])
        rows.append((2000 + k, " ".join(t)))
    docs = clashing(odd.drop(*CLASHES).unionByName(docs_frame(spark, rows)))
    labels = spark.createDataFrame([(i, int((i - 2000) % 5 == 0)) for i, _ in rows if i // 7 % 4 != 2] + [(None, 1), (1, 1)], "doc_id long, toxic int")
    machine = fit_toxicity(docs, labels)
    out = {r.doc_id: r for r in toxicity(docs, machine).where("doc_id >= 2000").collect()}
    held = [i for i, _ in rows if i // 7 % 4 == 2]
    assert sum(out[i].predicted == ((i - 2000) % 5 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity(docs, machine).where("score is null or score < 0 or score > 1").count() == 0 and toxicity(docs, machine).count() == docs.count()
    tricks = docs_frame(spark, [(1, "such an i.d.i.o.t here"), (2, "s c u m of all"), (3, "you IDIOT"), (4, "id-iot")])
    assert toxicity(tricks, machine).where("predicted = 1").count() == 4
    assert toxicity(docs.limit(0), machine).count() == 0 and toxicity(docs, fit_toxicity(docs, labels.limit(0))).where("predicted = 1").count() == 0


def base_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k + j for k, g in enumerate(grams) if g in many for j in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_rules(spark, odd):
    rng = random.Random(10)
    rows = [(3000 + k, words(rng, 60 + rng.randrange(60))) for k in range(300)] + [(3400, words(rng, 80).replace(" ", "### ")), (3401, "a b c a b c d\n\n x\nq\n x\n"), (3402, "\x0b a\x0cb\r\na\tb a b"), (3403, "one two three " * 40)]
    docs = clashing(odd.drop(*CLASHES).unionByName(docs_frame(spark, rows)))
    out = quality_rules(docs).collect()
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null and doc_id <> 6").collect()}
    for r in out:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_rules(texts[r.doc_id]), r
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert not kept[3400] and all(kept[3000 + k] for k in range(300)) and len(out) == docs.count()
    assert quality_rules(docs.limit(0)).count() == 0
    few = quality_rules(docs.where("doc_id between 3000 and 3020")).collect()
    assert all(r.kept and r.distance is None for r in few)


def test_an_outlier_in_each_statistic_goes(spark):
    """Beside 200 plain texts: long words, symbols, equal lines, repeated words, very many words, each alone in its text."""
    rng = random.Random(11)
    plain = [words(rng, 60 + k % 60) for k in range(200)]
    line = "a"  # over one-word lines, as long as no three of them come twice
    while more := [c for c in "edcba" if f"{line}\n{c}"[-5:] not in line]:
        line += "\n" + more[0]
    phrase = words(rng, 48)
    planted = [words(rng, 90).replace(" ", "abcdefgh "), words(rng, 90).replace(" ", "$ ", 30), line, f"{phrase} {words(rng, 100)} {phrase}", words(rng, 3000)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(plain + planted)], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert all(out[k].kept for k in range(200))
    assert out[202].n_repeat_words == 0 and out[202].n_dup_lines > 50 and out[203].n_dup_lines == 0
    assert [k for k in range(200, 205) if out[k].kept or out[k].base_failed] == []


def mcd(x, share=0.75, floors=(0.02, 0.243, 0.78, 0.567, 0.1)):
    """NumPy concentration from the same three starts, on exact distances, each until its determinant stops falling; the best one's mean, covariance and determinant."""
    from tallyframe.llm.quality_rules import CONSISTENT

    def cholesky(c):
        low = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                rest = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, floors[i] ** 2)) if i == j else rest / low[j, j]
        return low

    median, sd = np.median(x, axis=0), np.subtract(*np.quantile(x, [0.75, 0.25], axis=0)) / 1.349
    whole = np.cov(x.T, bias=True)
    best = None
    for mean, cov in ((median, np.diag(sd**2)), (x.mean(axis=0), whole), (median, whole)):
        last = np.inf
        for _ in range(60):
            low = cholesky(cov)
            d = (np.linalg.solve(low, (x - mean).T) ** 2).sum(axis=0)
            near = x[np.argsort(d)[: int(np.ceil(share * len(x)))]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True)
            cov = cov * CONSISTENT[max(1, sum(cov[i, i] > floors[i] ** 2 for i in range(5))) - 1]
            now = 2 * np.log(np.diag(cholesky(cov))).sum()
            if now >= last - 1e-6:
                break
            last = now
        if best is None or now < best[2]:
            best = mean, cov, now
    return best


@pytest.mark.parametrize("seed", [3, 4])
def test_mcd_is_that_of_numpy(spark, seed):
    """Two clusters and far outliers, correlated statistics: centre, spread and determinant are those of a plain NumPy estimate on the same rows."""
    from tallyframe.llm.quality_rules import FEATURES, _estimate, _scaled

    rng = np.random.default_rng(seed)
    mix = np.eye(5) + 0.4 * np.tri(5, k=-1)
    bulk, near, out = rng.normal(size=(500, 5)) @ mix.T, rng.normal(size=(60, 5)) + 6, rng.normal(size=(60, 5)) + 30
    x = np.vstack([bulk, near, out])
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{f} double" for f in FEATURES))
    mean, cov, logdet = mcd(x)
    est = _estimate(rows)
    row = _scaled(rows, est).first()
    low = np.array([[row[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert row.n == len(x)
    assert np.abs(np.array([row[f"m{k}"] for k in range(5)]) - mean).max() < 0.15
    assert np.abs(low @ low.T - cov).max() < 0.25 * np.abs(cov).max()
    assert abs(2 * np.log(np.diag(low)).sum() - logdet) < 0.3
    assert all(abs(row[f"m{k}"]) < 0.5 for k in range(5))  # the bulk, not the outliers


def test_bounded_samples(spark):
    from tallyframe.llm.spark_io import bounded_sample

    rows = spark.range(20_000)
    some = bounded_sample(rows, "id", 1000)
    assert 950 <= some.count() <= 1250 and sorted(some.collect()) == sorted(bounded_sample(rows.repartition(7), "id", 1000).collect())
    assert bounded_sample(rows, "id", 20_000).count() == 20_000 and bounded_sample(rows.limit(0), "id", 5).count() == 0
