"""The registered queries on a small folder of tables, against brute force or the libraries themselves."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lodestrand.llm import langid, mixing, pii, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
PASSAGE = " ".join(f"shared{i} passage{i * 7 % 31}" for i in range(30))
ODD = [
    None, "", " \x1c\n", "a <|endoftext|> b", "<|endoftext|>", "x\0y  z", "▁ ▁▁a", " \x85 é", "12 34", "w" * 3000 + " end",
    "mail bob at example dot org or a.b@c-d.example.com, from 10.0.0.256 and 10.0.0.25", "card 4111 1111 1111 1111 phone +1 (212) 555-0188",
    'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" was the of and that', PASSAGE + " one tail of its own", "a head before " + PASSAGE,
    " ".join(f"n{i}" for i in range(60)), " ".join(f"n{i}" for i in range(60)) + " more", " ".join(f"N{i}" for i in range(60)),
]


@pytest.fixture(scope="module")
def rows(spark):
    got = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    more = [(5000 + i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(ODD)]
    return sorted(got + more)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def run(spark, folder, name):
    return {r.doc_id: r for r in registry.queries()[name](spark, folder).collect()}


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(n if i % 2 == 0 else 2 * n - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d))))
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 14 <= len(d) <= 19 and total % 10 == 0 or kind == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_op1(spark, rows, folder):
    got = run(spark, folder, "op1_personal_data")
    assert set(got) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        base, r = plain_spans(text or ""), got[doc_id]
        shown = [f"{pii.KINDS[k]}:{lo}:{hi}" for lo, k, hi in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(shown) <= set(every) and r.n_spans == len(every) == len(shown) + r.n_added
    secret = next(i for i, t in enumerate(ODD) if t and "token =" in t)
    assert got[5000 + secret].spans == f"secret:{ODD[secret].index('04db')}:{ODD[secret].index('04db') + 40}" and got[5000 + secret].n_secret == 1


def test_op3(spark, rows, folder, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got, start = run(spark, folder, "op3_token_ids"), 0
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc(ids)), text
        start += len(ids)
    assert len(got) == len(rows)


def classes(rows) -> dict:
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [(r[1] or "").lower().split()] if w for i in range(max(1, len(w) - 4))} for r in rows}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in ids}


def test_op4(spark, rows, folder):
    assert {d: r.class_id for d, r in run(spark, folder, "op4_near_duplicates").items()} == classes(rows)


def plain_hash(payload: bytes) -> str:
    """The cosine hash from its definition, pixel by pixel."""
    h = len(payload) // 192
    grey = [[sum(payload[y * 192 + 3 * x : y * 192 + 3 * x + 3]) / 3 for x in range(64)] for y in range(h)]
    strip = lambda n, i: [i * n // 32] if n < 32 else range(i * n // 32, (i + 1) * n // 32)
    small = [[np.mean([np.mean([grey[y][x] for y in strip(h, i)]) for x in strip(64, j)]) for j in range(32)] for i in range(32)]
    wave = [[math.cos(math.pi * u * (2 * x + 1) / 64) for x in range(32)] for u in range(8)]
    value = lambda u, v: sum(wave[u][i] * wave[v][j] * small[i][j] for i in range(32) for j in range(32))
    flat = [value(u, v) for u in range(8) for v in range(8)]
    return np.packbits([x > np.median(flat[1:]) for x in flat]).tobytes().hex()


def test_op5(spark, rows, folder):
    got = run(spark, folder, "op5_media_columns")
    for n, (doc_id, text, *_) in enumerate(rows):
        raw, r = (text or "").encode(), got[doc_id]
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        if n % 40 == 0 and len(raw) > 1000:
            assert (int(r.feature, 16) ^ int(plain_hash(pad), 16)).bit_count() <= 2  # other orders of adding may move a value across the median
    same = defaultdict(set)
    for doc_id, text, *_ in rows:
        same[text or ""].add((got[doc_id].media_sha256, got[doc_id].media_bytes, got[doc_id].feature))
    assert all(len(v) == 1 for v in same.values())


def test_op7(spark, rows, folder, path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    got = run(spark, folder, "op7_sentencepiece")
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        assert (got[doc_id].n_pieces, got[doc_id].ids_crc32, got[doc_id].round_trip) == (len(ids), crc(ids), True), text


def test_op8(spark, rows, folder):
    got = run(spark, folder, "op8_repeated_passages")
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    seen = Counter(b[i : i + 200] for b in texts.values() for i in range(len(b) - 199))
    assert sum(r.n_removed > 0 for r in got.values()) > 3
    for doc_id, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone.tolist(), strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone.tolist()) if g and (i == 0 or not gone[i - 1]))
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def shares(text: str, model: langid.Model) -> dict[str, float]:
    """Mean marginals of one text, word by word in one pass (texts here are shorter than a window or cut like it)."""
    words = [w for w in text.lower().split()]
    if not words:
        return {}
    scores, has = langid.emissions(words, model.weights)
    flat = np.flatnonzero(has)
    if not len(flat):
        return {}
    means = langid.document_marginals(flat, np.array([0, len(flat)]), scores, model.moves)[0]
    return dict(zip(model.labels, means.tolist(), strict=True))


def test_pipeline(spark, rows, folder, path, monkeypatch):
    import sentencepiece

    model = pii.Model(pii.fresh(1))  # spans by chance, but the same ones on both sides
    monkeypatch.setattr(pii, "fit", lambda docs: model)
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    language = langid.fit(langid.learnable(documents), other=True)
    got = Counter((r.doc_id, r.lang, r.source, r.n_pieces, r.ids_crc32, r.round_trip) for r in corpus_pipeline.run(spark, folder).collect())
    docs = []
    for doc_id, text, lang, source, _ in rows:
        found = shares(text or "", language)
        strange = found.pop(langid.OTHER, 0.0)
        if found and not (language.words >= corpus_pipeline.LEAST_WORDS and strange >= corpus_pipeline.MOST_OTHER):
            docs.append((doc_id, text, lang or max(sorted(found), key=found.get), source))
    name = classes(docs)
    docs = [d for d in docs if name[d[0]] == d[0]]
    assert 100 < len(docs) < len(rows)
    masked = []
    for doc_id, text, lang, source in docs:
        out, at = [], 0
        for lo, kind, hi in pii.merged(text, pii.base_spans(text), pii.model_spans([text], model)[0]):
            if lo >= at:
                out += [text[at:lo], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, hi)
        masked.append((doc_id, "".join([*out, text[at:]]), lang, source))
    cell = {}
    for doc_id, text, lang, source in masked:
        topic = next((t for t, p in mixing.TOPICS if re.search(p, text)), "prose")
        cell[doc_id] = (source or "unknown", lang, topic)
    counts = defaultdict(float)
    for doc_id, text, *_ in masked:
        counts[cell[doc_id]] += len(re.findall(mixing.WORD, text))
    weight, total = dict(counts), sum(counts.values())
    goals = []
    for d in range(3):
        own = defaultdict(float)
        for c, n in counts.items():
            own[c[d]] += n
        root = sum(math.sqrt(n) for n in own.values())
        goals.append({k: math.sqrt(n) / root * total for k, n in own.items()})

    def masses(d):
        out = defaultdict(float)
        for c, w in weight.items():
            out[c[d]] += w
        return out

    for _ in range(mixing.SWEEPS):
        for d in range(3):
            mass = masses(d)
            weight = {c: w * goals[d][c[d]] / mass[c[d]] if mass[c[d]] else 0.0 for c, w in weight.items()}
        if max(abs(m / goals[d][k] - 1) for d in range(2) for k, m in masses(d).items() if m) <= mixing.TOLERANCE:
            break
    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = Counter()
    for doc_id, text, lang, source in masked:
        c = cell[doc_id]
        rate = 0.5 * (weight[c] / counts[c] if counts[c] else 1.0)
        draw = int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        copies = math.floor(rate) + (draw < rate - math.floor(rate))
        if copies:
            ids = library.encode(text)
            want[doc_id, lang, source, len(ids), crc(ids), True] += copies
    assert got == want
