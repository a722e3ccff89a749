"""BPE, chat formatting, licenses and personal data against the library, round trips and brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from assayer.llm import bpe, chat, licenses, pii

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(docs_of, edge_rows, library):
    rng = random.Random(1)
    rows = edge_rows + [(100 + k, "".join(rng.choice("aabcde \n'streé😀019_") for _ in range(200))) for k in range(60)] + [(200, "aaaaaaaa" * 40)]
    docs = docs_of(rows)
    text = {i: t or "" for i, t in rows if i is not None}
    for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        if r["doc_id"] is not None:
            assert r["ids"] == library.encode_ordinary(text[r["doc_id"]])
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[(i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()) == want


def test_bpe_cache_starts_anew(library):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, cache_words=5)
    for text in ("one two three four five six", "seven one", "six seven eight", ""):
        (places,) = codec.encode([text])
        assert codec.ids_of(places).tolist() == library.encode_ordinary(text)


def test_replay_equals_single_merges():
    ranks = bpe.ranks_of(RANKS)
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    assert ranks.replay(words) == [ranks.merge_one(w) if w else [] for w in words]


def test_decode(spark):
    tokens = spark.createDataFrame([(1, [36, 325]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(tokens, RANKS).collect()}
    assert got[2] == got[3] == b"" and len(got[1]) > 1


TURNS = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\<|im_start|>", "<\\|", "<\\\\|", "a\n<|im_end|>\n<|im_start|>user\n", "\\", "", None, "é😀", "<", "|>"]
    rows = [(k, t, role, nasty[(k * 3 + t) % len(nasty)], "x") for k in range(20) for t, role in enumerate(["user", "assistant"] * 2)]
    rows += [(50, 1, "a\nb<|", "x", ""), (50, 0, None, "y", ""), (None, None, "user", "z", ""), (60, 2, "user", "b", ""), (60, 2, "user", "a", "")]
    made = chat.format_chats(spark.createDataFrame(rows, TURNS)).withColumn("back", chat.read_back(F.col("formatted")))
    for r in made.collect():
        own = sorted(((t, role or "", x or "") for c, t, role, x, _ in rows if c == r["conv_id"]), key=lambda x: (x[0] is not None, x[0], x[1], x[2]))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(role, x) for _, role, x in own]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_chat_machine(spark):
    def verdict(*roles):
        rows = [(1, i, role, "t", "") for i, role in enumerate(roles)]
        r = chat.format_chats(spark.createDataFrame(rows, TURNS)).first()
        return r["valid"], r["bad_turn"]

    assert verdict("system", "user", "assistant", "user") == (True, None)
    assert verdict("user", "assistant") == (True, None)
    assert verdict("assistant") == (False, 0)
    assert verdict("user", "user", "assistant") == (False, 1)
    assert verdict("user", "assistant", "tool") == (False, 2)


def test_chat_loss_text(spark):
    rows = [(1, 0, "user", "q", ""), (1, 1, "assistant", "<|a|>", ""), (1, 2, "user", "r", ""), (1, 3, "assistant", "b\\", "")]
    r = chat.digest(chat.format_chats(spark.createDataFrame(rows, TURNS))).first()
    assert r["loss_chars"] == 7 and r["loss_sha256"] == hashlib.sha256(b"<|a|>b\\").hexdigest()
    assert chat.digest(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def expected_licenses(rows):
    out = {}
    for i, t in rows:
        words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is None or not words:
            continue
        have = [" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        for name, text in licenses.TEMPLATES.items():
            template = licenses.template_shingles(text)
            n = len(template)
            best = max(len(set(template) & set(have[k : k + 2 * n])) / n for k in range(0, len(have), n + 1))
            if best >= 0.75:
                out[i, name] = max(best, out.get((i, name), 0))
    return out


def test_licenses(docs_of, edge_rows):
    notice = licenses.TEMPLATES["MIT-permission"]
    rows = edge_rows + [(100 + k, f"some words before it {t} and words after") for k, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(200, notice.replace("free of charge", "gratis")), (201, " ".join(notice.split()[:12])), (202, ("x y " * 9 + "Released under the MIT License. ") * 3)]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs_of(rows)).collect()}
    assert got == pytest.approx(expected_licenses(rows))
    assert len(got) >= len(licenses.TEMPLATES) and licenses.scan(docs_of([])).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((m.start(), place, m.end()))
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_base_spans(docs_of, edge_rows):
    rng = random.Random(8)
    pieces = [
        "a@b.c", "x.y@z-1.co.uk_d@e.f", "@", "+", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0199",
        "+49 30 1234567.", " ", "é", "😀", "0", "9", ".", "-", "(", "00000000000000", "word", "\n", "mail me at joe [at] example [dot] com", "call 212-555-0188 now",
    ]
    rows = edge_rows + [(300 + k, "".join(rng.choice(pieces) for _ in range(14))) for k in range(150)] + [(900, "7 " * 30_000), (901, "a" * 30_000 + "@b.c"), (902, "1.2.3.4 a@b.c " * 2000)]
    text = {i: t for i, t in rows if i is not None}
    got = [r for r in pii.find(docs_of(rows)).collect() if r["doc_id"] is not None]
    assert len(got) == len([i for i, _ in rows if i is not None])
    for r in got:
        want = base_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    assert pii.find(docs_of([])).count() == 0


def test_reliabilities_follow_agreement():
    good, bad = (1, 1, 1, 1), (-1, -1, 0, -1)
    p = pii.reliabilities([(0, good, 50), (0, bad, 50), (0, (0, 1, 1, 1), 5), (0, (0, -1, 0, -1), 5)])
    assert p[0, good] > 0.95 > 0.05 > p[0, bad] and p[0, (0, 1, 1, 1)] > 0.9 and p[0, (0, -1, 0, -1)] < 0.1


def test_loose_spans_are_added(docs_of):
    strict = [(i, f"mail bob{i}@mail{i % 7}.example.com or call +1 (212) 555-0{100 + i} today") for i in range(60)]
    rows = strict + [(100, "call 212-555-0188 now"), (101, "mail joe [at] example [dot] com now"), (102, "plain words only")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs_of(rows)).collect()}
    assert got[100] == "phone:5:17" and got[101].startswith("email:5:") and got[102] == ""
