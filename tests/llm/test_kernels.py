"""Kernels of the training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrand.llm import ann, langid, media, neardup, pieces, pii, suffix_dedup, token_store, warc

TOKENIZER, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["", " ", "a  b", "  lead", " x ", "tab\there", "nl\n\nx y", "it's don't 's", "x² ½a", "\x00", "a\x00b c", "日本 語", "a b  c", "end. \n\nNext  ", "▁x a▁b", "😀 𝔘", "supercali" * 60, "<|endoftext|> a"]


def noise(seed: int, alphabet: str, n: int = 400, size: int = 50) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def paths():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path


def test_token_ids(paths):
    from tokenizers import Tokenizer

    texts = ODD + noise(1, "ab 'st\n.é²½1_日 \x1c\x00\x85　") + noise(2, "ab 'st\n.é1_ßñ,!")
    texts += [f"a{x}{mark}{y}b" for mark in ("<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "|endoftext|>") for x in ("", " ", "  ", "\0", "word ") for y in ("", " ", "\n", " more words ", "\0 ")]
    texts += ["<|endoftext|>", "<|endoftext|> starts", "ends <|endoftext|>"]
    plain = Tokenizer.from_file(paths(TOKENIZER))
    ids, begin = token_store.word_encoder(paths(TOKENIZER))(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert got == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_piece_ids(paths):
    import sentencepiece

    texts = ODD + noise(3, "abcdeti  ▁on.\nhéß語😀")
    work = pieces.Encoder(paths(MODEL), remembered=50)
    got = work.encode(texts) and work.encode(texts)
    assert [x.tolist() for x in got] == sentencepiece.SentencePieceProcessor(model_file=paths(MODEL)).encode(texts)
    assert [work.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_remembered_words_are_bounded_within_a_batch(paths):
    work = pieces.Encoder(paths(MODEL), remembered=5)
    got = work.encode([" ".join(f"w{i}" for i in range(40))])
    assert len(work.known) == 5 and work.decode(got[0]) == " ".join(f"w{i}" for i in range(40))


PATTERNS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text: str) -> list:
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    known = ["mail a.b@c-d.example.com, a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+1 23", "é@x.y", ""]
    for text in known + noise(5, "a1.@+-2 ()9%", 4000, 60):
        assert pii.base_spans(text) == plain_spans(text), text
    long = "a" * 200_000 + "@" + "1" * 100_000 + "." + "2 " * 100_000
    assert isinstance(pii.base_spans(long), list)  # no quadratic scan


@pytest.fixture(scope="module")
def prose():
    import pyarrow.parquet as pq

    return [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t]


def test_no_language():
    """Junk and unlearned languages are strange; clean texts, short ones with a licence line too, are not."""
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist() if r["text"]]
    rng = random.Random(3)
    model = langid.train([r["text"][:3000] for r in rows[::2]], [r["lang"] for r in rows[::2]], other=True)
    assert model.labels[-1] == langid.OTHER and model.words >= 1000

    def strange(text):
        words = text.lower().split()
        scores, has = langid.emissions(words, model.weights)
        flat = np.flatnonzero(has)
        return langid.document_marginals(flat, np.array([0, len(flat)]), scores, model.moves)[0, -1]

    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 10))) for _ in range(60)), " ".join(rng.choice(["asdf", "qwerty", "zxcv", "fghj"]) for _ in range(60))]
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Все люди рождаются свободными и равными в своем достоинстве и правах."]
    assert all(strange(t) >= 0.6 for t in junk + foreign)
    held = [r["text"] for r in rows[1::2]]
    clean = held + [t + "\nThis work is licensed under the GNU General Public License, version 3." for t in held if 30 < len(t) < 200]
    assert np.mean([strange(t) >= 0.6 for t in clean]) <= 0.005


@pytest.fixture(scope="module")
def pii_model(prose):
    return pii.train(*pii.examples([t[:4000] for t in prose[::3]]))


def planted(prose: list[str], n: int = 400) -> list[tuple[str, int, int, int]]:
    """Items that no pattern finds, set between words of texts that the model did not learn from: (text, start, kind, end)."""
    rng, out = np.random.default_rng(77), []
    texts = [t for t in prose[1::3] if len(t) > 300 and not pii.base_spans(t) and not pii._TRIGGER.search(t)]
    while len(out) < n:
        item, kind, lead = pii.invent(rng)
        if kind < 0 or pii.base_spans(item):
            continue
        t = texts[int(rng.integers(len(texts)))]
        at = t.find(" ", int(rng.integers(len(t) - 100))) + 1
        out.append((t[:at] + lead + item + (lead[-1:] if lead[-1:] in "\"'" else "") + " " + t[at:], at + len(lead), kind, at + len(lead) + len(item)))
    return out


def test_pii_model(prose, pii_model):
    """Recall and precision of what only the model can find."""
    rows = planted(prose)
    found = [pii.merged(t, pii.base_spans(t), f) for (t, *_), f in zip(rows, pii.model_spans([t for t, *_ in rows], pii_model), strict=True)]
    hit = sum((lo, k, hi) in f for (_, lo, k, hi), f in zip(rows, found, strict=True))
    print("planted", len(rows), "found", hit, "spans", sum(map(len, found)))
    assert hit / len(rows) >= 0.8 and hit / sum(map(len, found)) >= 0.85
    clean = [t for t in prose[1::3] if not pii._ASSIGNED.search(t)]
    extra = [set(pii.merged(t, pii.base_spans(t), f)) - set(pii.base_spans(t)) for t, f in zip(clean, pii.model_spans(clean, pii_model), strict=True)]
    assert sum(map(len, extra)) <= len(clean) // 100


def test_pii_spans_do_not_depend_on_the_batch(prose, pii_model):
    texts = [t for t, *_ in planted(prose, 60)] + ["", "no trigger here", "9" * 3000, "call (212) 555-0188", "x " * 500 + "+1 (212) 555-0188" + " y 7" * 400]
    together = pii.model_spans(texts, pii_model)
    assert together == [pii.model_spans([t], pii_model)[0] for t in texts]
    assert together[60] == together[61] == []
    assert sum(hi - lo for lo, hi in pii.stretches("word " * 500 + "call (212) 555-0188 now" + " word" * 500)) < 400
    # a stretch of one window is one plain pass of the network
    x = pii.codes("mail bob at example dot org please")
    row = np.full((1, pii.WINDOW), 32)
    row[0, : len(x)] = x
    assert np.allclose(pii.scored([x], pii_model)[0], pii.emissions(pii_model, row)[0], atol=1e-4)


def test_pii_gradients():
    """Of the LSTM, the embedding and the CRF, against differences of the log-likelihood."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in pii.fresh(2, embed=3, hidden=2).items()}
    x, gold = rng.integers(30, 60, (2, 6)), np.array([[0, 1, 2, 2, 0, 0], [3, 4, 0, 5, 6, 0]])

    def likelihood(p):
        model = pii.Model(p)
        s, moves, total = pii.emissions(model, x), model.moves, 0.0
        for n in range(len(x)):
            a = s[n, 0]
            for i in range(1, x.shape[1]):
                a = np.log(np.exp(a[:, None] + moves).sum(axis=0)) + s[n, i]
            path = s[n, np.arange(x.shape[1]), gold[n]].sum() + moves[gold[n, :-1], gold[n, 1:]].sum()
            total += path - np.log(np.exp(a).sum())
        return total

    grad = pii.gradients(p, pii.Model(p).moves, x, gold)
    for k in p:
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in p[k].shape)
            if k == "e":
                at = (int(x[0, int(rng.integers(6))]), at[1])
            if k == "t" and not pii._allowed()[at]:
                continue
            moved = []
            for step in (1e-4, -1e-4):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += step
                moved.append(likelihood(q))
            assert grad[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-4, rel=1e-3, abs=1e-5), (k, at)


def test_every_address_has_a_trigger():
    ats = ["@", " @ ", " at ", " AT ", "(at)", " [ at ] ", "{At}", "<at>"]
    dots = [".", " . ", " dot ", " DOT ", "(dot)", " [dot] ", "{ dot }", "<Dot>"]
    for host in ("example", "a-very-long-host-name-" * 5 + "x"):
        for at in ats:
            for dot in dots:
                span = f"john{at}{host}{dot}mail{dot}org"
                text = f"{'word ' * 60}{span}{' word' * 60}"
                assert pii.possible(0, span) and pii._TRIGGER.search(span), span
                assert pii.merged(text, [], [(300, 0, 300 + len(span))]) == [(300, 0, 300 + len(span))] or "@" in at
                if at in (" at ", " AT "):
                    assert any(lo <= 300 and 300 + len(span) <= hi for lo, hi in pii.stretches(text)), span
    rng = np.random.default_rng(1)
    made = [text for text, kind, _ in (pii.invent(rng) for _ in range(4000)) if kind == 0]
    assert any(re.search(r" at [a-z0-9-]+\.[a-z]", t) for t in made) and any(re.search(r" at .*\(dot\)", t) for t in made)


def test_merged_spans_touch_no_base_span():
    base = [(0, 2, 40), (2, 3, 5), (6, 3, 9), (10, 3, 12), (14, 3, 16), (18, 3, 20), (22, 1, 30), (50, 0, 60)]
    text = ("1234567890 " * 10)[:100]
    assert pii.merged(text, base, [(30, 3, 42), (40, 3, 52), (55, 3, 70), (60, 3, 72)]) == sorted(base)
    assert pii.merged("a (212) 555-0188 b", [], [(2, 3, 16)]) == [(2, 3, 16)]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_nearest():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((600, 32))
    v[10:40] = v[9]  # ties
    ids = np.arange(600)
    codes, scalars = ann.encode(v)
    who, what, score = ann.search_block(ids, codes, scalars, v, ids[::50], v[::50], 5, 3.0)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in ids[::50]:
        s = np.round(unit @ unit[q], 12)
        want = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert what[who == q].tolist() == want
        assert np.allclose(score[who == q], s[want])


@pytest.mark.parametrize("kind", [0, 1, 2, None])
def test_png(kind):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    blob = media.encode_png(pixels, filters=kind)
    assert (media.decode_png(blob) == pixels).all()
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(blob[:60] + bytes([blob[60] ^ 1]) + blob[61:])
    with pytest.raises(ValueError, match="signature"):
        media.decode_png(b"x" + blob)


def test_png_filters():
    """All five filters, against a pixel-by-pixel filter written from the format's definition."""
    rng = np.random.default_rng(2)
    pixels, c = rng.integers(0, 256, (10, 5, 3), dtype=np.uint8).reshape(10, 15), 3
    kinds = np.array([4, 3, 4, 1, 2, 2, 3, 0, 1, 4], np.uint8)
    rows = np.zeros_like(pixels)
    for y in range(10):
        for x in range(15):
            a = int(pixels[y, x - c]) if x >= c else 0
            b = int(pixels[y - 1, x]) if y else 0
            d = int(pixels[y - 1, x - c]) if y and x >= c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            rows[y, x] = (int(pixels[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    assert (media.unfilter(kinds, rows, c) == pixels).all()


def test_cosine_hash():
    rng = np.random.default_rng(3)
    some, other = (rng.integers(0, 256, (40, 64, 3), dtype=np.uint8) for _ in range(2))
    near = some.copy()
    near[3, 5] = 255 - near[3, 5]
    apart = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert apart(some, near) <= 4 < 16 < apart(some, other)
    assert len(media.cosine_hash(np.zeros((1, 64, 3), np.uint8))) == 16


def test_warc_records():
    raw = warc.render(3, "http://x/\n?é", "hé", "d" * 64, "response", None, 3, "2000-01-01T00:00:00Z")
    fields, block = warc.parse(raw)
    assert fields["WARC-Type"] == "response" and block.endswith("hé".encode()) and fields["WARC-Target-URI"] == "http://x/ ?é"
    with pytest.raises(ValueError, match="length"):
        warc.parse(raw + b"x")
    rows = [("a", 0, 5), ("a", 5, 5), ("a", 40, 5), ("b", 0, 5), ("b", 5, 100)]
    assert [(f, o, n, i, j) for f, o, n, i, j in warc.ranges(rows, 10, 50)] == [("a", 0, 10, 0, 2), ("a", 40, 5, 2, 3), ("b", 0, 5, 3, 4), ("b", 5, 100, 4, 5)]


def test_probminhash():
    """Agreement of registers estimates the exact probability Jaccard; without repeats that is the plain one."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    texts = [" ".join(base)] + [" ".join(w if rng.random() > p else rng.choice(words) for w in base) for p in (0.005, 0.02, 0.05)] + [" ".join(base[:50] * 8)]
    doc, h, count = neardup.shingles(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    for weigh in (np.ones_like, lambda n: 1 + np.log(n)):
        w = weigh(count).astype(float)
        many = neardup.signatures(len(texts), doc, h, w, 4000)
        each = [dict(zip(h[cut[j] : cut[j + 1]].tolist(), w[cut[j] : cut[j + 1]].tolist(), strict=True)) for j in range(len(texts))]
        for j in range(1, len(texts)):
            a, b = each[0], each[j]
            exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in a.keys() & b.keys())
            assert abs((many[0] == many[j]).mean() - exact) < 0.035
            if (w == 1).all():
                plain = neardup.similarity(h[: cut[1]], h[cut[j] : cut[j + 1]])
                assert plain == pytest.approx(len(a.keys() & b.keys()) / len(a.keys() | b.keys())) == pytest.approx(exact)


def test_blank_texts():
    assert {c for c in map(chr, range(0x110000)) if not c.split()} == {c for c in map(chr, range(0x110000)) if re.fullmatch(f"[{neardup.BLANK}]", c)}


def test_shingles():
    doc, h, count = neardup.shingles([None, "", " ", "one two", "one two", "a b c d e a b c d e", "a b c d e"])
    per = Counter(doc.tolist())
    assert (per[0], per[1], per[2], per[3], per[5], per[6]) == (0, 0, 0, 1, 5, 1)
    assert h[doc == 3] == h[doc == 4] and sorted(count[doc == 5].tolist()) == [1, 1, 1, 1, 2]


@pytest.mark.parametrize("length", [5, 20, 70])
def test_repeats_in_contexts(length):
    rng = random.Random(length)
    for alphabet in (b"a", b"ab", b"abcdefgh", bytes(range(256))):
        for _ in range(8):
            base = bytes(rng.choice(alphabet) for _ in range(300))
            texts = []
            for _ in range(rng.randint(1, 10)):
                a = rng.randint(0, 200)
                t = bytearray(base[a : a + rng.randint(length, length + 60)])
                if len(t) >= length:
                    if rng.random() < 0.6:
                        t[rng.randrange(len(t))] = rng.choice(alphabet)
                    texts.append(bytes(t))
            if texts:
                size = np.array([len(t) for t in texts])
                got = suffix_dedup.repeated(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, length)
                seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
                assert got.tolist() == [seen[t[i : i + length]] > 1 for t in texts for i in range(len(t) - length + 1)]


def test_langid():
    en = ["the house and the tree stand by the water and the wind blows over them"] * 4
    de = ["das haus und der baum stehen am wasser und der wind weht über sie"] * 4
    model = langid.train(en + de, ["en"] * 4 + ["de"] * 4, sequences=300, epochs=2)
    words = "the house and der baum und das wasser".split()
    scores, has = langid.emissions(words, model.weights)
    assert has.all()
    marginals = langid.forward_backward(scores[None], np.array([len(words)]), model.moves)[0]
    assert [model.labels[i] for i in marginals.argmax(axis=1)] == ["en"] * 3 + ["de"] * 5
    # windows of a long text agree with one exact pass over all of it
    many = np.random.default_rng(0).integers(0, len(words), 3000)
    whole = langid.forward_backward(scores[many][None], np.array([3000]), model.moves)[0].mean(axis=0)
    assert np.allclose(langid.document_marginals(many, np.array([0, 3000]), scores, model.moves)[0], whole, atol=1e-3)
    assert langid.train([], []) is None
    assert langid.emissions(["12", "a1", "..."], model.weights)[1].tolist() == [False, True, False]


def test_exact_marginals():
    """Forward-backward against the sum over all label sequences."""
    import itertools

    rng = np.random.default_rng(3)
    scores, moves = rng.standard_normal((1, 4, 3)), rng.standard_normal((3, 3))
    total, want = 0.0, np.zeros((4, 3))
    for ys in itertools.product(range(3), repeat=4):
        w = np.exp(sum(scores[0, i, y] for i, y in enumerate(ys)) + sum(moves[a, b] for a, b in itertools.pairwise(ys)))
        total += w
        for i, y in enumerate(ys):
            want[i, y] += w
    assert np.allclose(langid.forward_backward(scores, np.array([4]), moves)[0], want / total)


def test_crf_gradient():
    rng = np.random.default_rng(4)
    scores, gold, moves = rng.standard_normal((2, 5, 9)), rng.integers(0, 9, (2, 5)), rng.standard_normal((9, 9))

    def likelihood(s, m):
        out = 0.0
        for n in range(2):
            a = s[n, 0].copy()
            for i in range(1, 5):
                a = np.log(np.exp(a[:, None] + m).sum(axis=0)) + s[n, i]
            out += sum(s[n, i, y] for i, y in enumerate(gold[n])) + sum(m[gold[n, i], gold[n, i + 1]] for i in range(4)) - np.log(np.exp(a).sum())
        return out

    ds, dm = pii._crf(scores, gold, moves)
    for i in (0, 3):
        bump = np.zeros_like(scores)
        bump[1, i, 2] = 1e-5
        assert ds[1, i, 2] == pytest.approx((likelihood(scores + bump, moves) - likelihood(scores - bump, moves)) / 2e-5, abs=1e-5)
    bump = np.zeros_like(moves)
    bump[1, 2] = 1e-5
    assert dm[1, 2] == pytest.approx((likelihood(scores, moves + bump) - likelihood(scores, moves - bump)) / 2e-5, abs=1e-5)


def test_crc_of_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_intersections():
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 40, 300)
    sets = [np.unique(np.r_[rng.choice(common, 200), rng.integers(0, 1 << 40, 20), common[: rng.integers(0, 9)]]) for _ in range(60)]
    sets += [np.unique(rng.choice(common[:8], 5)) for _ in range(5)]
    got = neardup.intersections(sets[:25], sets[20:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:25]]).all()
