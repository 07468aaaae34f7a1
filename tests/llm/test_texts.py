"""Word scanning, pieces, range coder, chunks, alignment: pure Python parts against brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import chat, decontaminate, passages, range_coder, toxicity, vectext
from tallyframe.llm.urls import RuleTrie, split_url

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAb é\n\t\x0b一.", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = vectext.scan_words(pa.array(texts, pa.string()))
    want = [[w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for t in texts]
    assert list(np.diff(words.bounds)) == [len(w) for w in want]
    known = {}
    for h, w in zip(words.hashes, [w for ws in want for w in ws]):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_slices_cross_words_and_texts(monkeypatch):
    texts = ["ab " * 30, "x" * 100, "", "end of it"]
    whole = vectext.scan_words(pa.array(texts))
    monkeypatch.setattr(vectext, "SLICE_BYTES", 16)
    parts = vectext.word_ranges(*vectext.buffers(pa.array(texts)))
    assert list(parts[0]) == list(whole.starts) and list(parts[1]) == list(whole.ends)


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles(texts, size):
    hashes, owner = vectext.shingle_hashes(vectext.scan_words(pa.array(texts, pa.string())), size)
    for k, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []
        got = hashes[owner == k]
        assert len(got) == len(want) and len(set(got)) == len(set(want))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=60), max_size=5))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, dtype=np.int64) for b in blocks]
    back = range_coder.decode_blocks(range_coder.encode_blocks(arrays), [len(b) for b in arrays])
    assert all((a == b).all() for a, b in zip(arrays, back))


def test_range_coder_learns_and_checks():
    ids = np.tile(np.arange(50) * 1000, 80)
    payload = range_coder.encode_blocks([ids])[0]
    assert len(payload) < len(ids)  # under a byte for an id of two
    broken = bytes([payload[0] ^ 1]) + payload[1:]
    with pytest.raises(range_coder.CorruptBlock):
        range_coder.checked(range_coder.decode_blocks([broken], [len(ids)])[0], zlib.crc32(range_coder.id_bytes(ids)))
    a, b = b"some bytes", b"and more" * 99
    assert range_coder.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_equal_the_library():
    import public_tokenizers
    import sentencepiece

    from tallyframe.llm.pieces import SPACE, Pieces, StreamingViterbi

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ["", " ", "Hello  world\n x", "é一\U0001f600 \t\x00", "a\r\nb  ", "ab" * 400] + ["".join(rng.choice("abcdehilnorst  .\n\té一ñ0_<>x") for _ in range(rng.randrange(80))) for _ in range(400)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u2").tolist()
        assert ids == library.encode(t) and own.decode(ids) == library.decode(ids) == t
        stream, out, s = StreamingViterbi(own), [], (SPACE + t).replace(" ", SPACE) if t else ""
        at = 0
        while at < len(s):
            n = rng.randrange(1, 9)
            out += stream.push(s[at : at + n])
            assert len(stream.ends) <= 40 * own.longest
            at += n
        assert out + stream.finish() == ids


def test_chunks_resist_shifts_and_neighbours():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(51)).encode()
    a = " ".join(rng.choice(words) for _ in range(60)).encode() + b" " + passage + b" tail"
    b = b"\n" + passage + " ".join(rng.choice(words) for _ in range(90)).encode()
    text, start, end, digest, n_words = passages.chunks_of([a, b"", b])
    for k, t in enumerate([a, b"", b]):
        own = text == k
        assert b"".join(t[s:e] for s, e in zip(start[own], end[own])) == t
        for s, e in zip(start[own], end[own]):
            t[s:e].decode()  # no chunk ends inside a character
    assert sum(n_words) == len(a.split()) + len(b.split())
    shared = np.isin(digest, digest[text == 0]) & (text == 2)
    assert n_words[shared].sum() >= passages.MIN_WORDS
    assert (passages.chunks_of([b])[3] == digest[text == 2]).all()


def test_alignment_is_smith_waterman():
    rng = random.Random(2)

    def brute(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    item = np.array([rng.randrange(6) for _ in range(12)], dtype=np.uint64)
    windows = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))], dtype=np.uint64) for _ in range(40)]
    for w, (score, matched, first, last) in zip(windows, decontaminate.align(item, windows)):
        assert score == brute(list(item), list(w)) and matched <= last - first + 1


def test_seeds_leave_common_grams_out():
    counts = np.array([5, 0, 5, 900, 5, 6, 5, 5, 900, 901, 902, 903, 4, 0, 5, 5, 5])
    keep = decontaminate.seed_grams(counts, np.zeros(17, int))
    assert list(np.flatnonzero(keep)) == [0, 2, 4, 5, 6, 7, 8, 12, 14, 15, 16]
    assert not decontaminate.seed_grams(np.zeros(3, int), np.zeros(3, int)).any()


def test_rules():
    trie = RuleTrie([("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "COM/de/"), ("allow", "b.com/x"), ("block", "b.com/x")])
    find = lambda u: trie.find(*split_url(u))
    assert find("http://a.Example.ORG/es/x") == ("block", "example.org/es/") and find("http://example.org/en/12") == ("block", "example.org/en/1")
    assert find("http://example.org/en/2") == ("allow", "org/") and find("http://x.com/de/1") == ("block", "com/de/") and find("http://x.com/dex") is None
    assert find("http://org") is None and find("http://notorg/") is None and find("http://b.com/xy") == ("block", "b.com/x")
    assert split_url(None) == split_url("nothing") == ("", "") and split_url("a://H.x?y/z") == ("h.x", "")


def test_templates():
    render = lambda source, messages: list(chat.compile_template(source)(messages))
    turns = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    out = render("A{# no #}{% for m in messages %}{% if loop.first %}1{% elif m.role == 'assistant' and loop.last %}L{% else %}x{% endif %}{% generation %}{{ m.text | upper }}{% endgeneration %}{% endfor %}{{ 'a' + 'b' }}", turns)
    assert "".join(t for t, _ in out) == "A1HILYOab" and [t for t, loss in out if loss] == ["HI", "YO"]
    assert chat.parse("{{ 'a' + 'b' | upper }}c{% if 1 == 2 %}x{% endif %}") == (chat.Out(chat.Const("aBc")),)
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% import os %}", "{% for m in messages %}", "{{ 'a' | eval }}", "{{ }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", "a", "/", " "]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def test_kernel_is_the_gapped_one():
    def features(w):
        out = {}
        for i in range(len(w)):
            for a, b in toxicity.PLACES:
                if i + b < len(w):
                    key = w[i] + w[i + a] + w[i + b]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (b + 1)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    words = ["idiot", "banana", "aaaaa", "idxiot", "mississippi"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    ids, weights = toxicity.subsequences(toxicity._codes(data, ends - [len(w) for w in words], ends))
    for w, i, v in zip(words, ids, weights):
        got = {}
        for a, b in zip(i, v):
            if a:
                got[a] = got.get(a, 0) + b
        assert np.allclose(sorted(got.values()), sorted(features(w).values()), atol=1e-5)


def test_words_of_one_digest_keep_their_own_ids(monkeypatch):
    """Known words are looked up by digest; words that share one are told apart."""
    import numpy as np
    import pyarrow as pa

    from tallyframe.llm import token_files
    from tallyframe.llm.q_token_files import tokenizer_path

    library = token_files.load_tokenizer(tokenizer_path())
    rounds = [["oak elm ash oak", "a b c d", ""], ["elm birch, ash\n\nfir", None, "d c oak\u2003yew"], ["oak elm ash"]]
    digests = token_files._digests
    for few in (0, 3):
        monkeypatch.setattr(token_files, "_digests", (lambda *a: digests(*a) % np.uint64(few)) if few else digests)
        coder = token_files.WordCoder(tokenizer_path())
        for texts in rounds:
            ids, counts = coder.texts(pa.array(texts, pa.string()))
            want = [library.encode(x or "", add_special_tokens=False).ids + [token_files.END_ID] for x in texts]
            assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_payload_of_blocks_is_fixed():
    """Files written by earlier versions are read and written alike; blocks of one call have different lengths."""
    import zlib

    import numpy as np

    from tallyframe.llm.range_coder import decode_blocks, encode_blocks

    blocks = [(np.arange(n, dtype=np.int64) ** 2 * 40503 // 7 % m).astype(np.uint16) for n, m in [(0, 1), (1, 9), (2048, 300), (700, 65536), (1500, 5), (49, 2), (2047, 40000)]]
    payloads = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(decode_blocks(payloads, [len(b) for b in blocks]), blocks))
    assert zlib.crc32(b"".join(payloads)) == 0xa50327aa
