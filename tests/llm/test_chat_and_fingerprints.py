import hashlib

import pytest
import xxhash
from llm.llm_helpers import WORD, documents, texts
from pyspark.sql import functions as F

from vocabmill.llm import chat, order_minhash as om
from vocabmill.llm.queries import op9_order_minhash

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part long, position long, a string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "z") for r in rows], SCHEMA).repartition(3)


def turns(conv, texts, start=0):
    return [(conv, start + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


ROWS = (
    turns(1, "ab") + turns(2, "abcd") + turns(3, "abc") + turns(4, "abcd") + turns(5, "abx") + turns(6, "a") + turns(7, "ba")
    + turns(8, ["a", None]) + turns(9, ["a", ""]) + [(10, 0, None, "a")] + turns(11, "abcde", start=5)
    + [(12, None, "user", "q"), (12, 1, "user", "r"), (12, 1, "user", "r")] + [(None, 0, "user", "n")] + turns(13, "zz") + turns(14, "z")
)


def plain(rows):
    """(conv, n_turns, n_copies, text) of maximal conversations."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    least = lambda v: (v is not None, v if v is not None else 0)
    word = lambda v: (v is not None, v or "")
    whole = {c: tuple((r, t) for _, r, t in sorted(own, key=lambda x: (least(x[0]), word(x[1]), word(x[2])))) for c, own in convs.items()}
    kept = {}
    for conv, own in whole.items():
        if not any(len(o) > len(own) and o[: len(own)] == own for o in whole.values()):
            kept.setdefault(own, []).append(conv)
    return {
        (min((c for c in ids if c is not None), default=None), len(own), len(ids), "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in own)) for own, ids in kept.items()
    }


@pytest.mark.parametrize("part", [256, 2])
def test_collapse(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    found = {}
    for r in chat.collapse(conversations(spark, ROWS)).collect():
        found.setdefault((r.conv_id, r.n_turns, r.n_copies), {})[r.part] = r.text
    for parts in found.values():
        assert sorted(parts) == list(range(len(parts)))
    assert {(*k, "".join(parts[i] for i in sorted(parts))) for k, parts in found.items()} == plain(ROWS)


def test_collapse_of_nothing(spark):
    assert chat.collapse(conversations(spark, [])).collect() == []


def long_hash(seed, *values):
    """Spark's xxhash64 of strings and longs, as a signed number."""
    for value in values:
        data = value.encode() if isinstance(value, str) else value[0].to_bytes(value[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def long(x):
    return (x, 8)


def packed(value, position, bits=om.POSITION_BITS):
    return ((value << bits) & (2**63 - 1)) | position


def plain_slots(text):
    words = WORD.findall(text or "")
    if not words:
        return []
    hashes = [long_hash(42, w) for w in words]
    kmers = sorted(packed(long_hash(42, *map(long, hashes[i : i + om.K])), i) for i in range(max(1, len(words) - om.K + 1)))
    numbered, seen = [], {}
    for value in kmers:
        h, position = value >> om.POSITION_BITS, value & (2**om.POSITION_BITS - 1)
        occurrence = seen[h] = seen.get(h, -1) + 1
        numbered.append(packed(long_hash(42, long(h), (occurrence, 4)), position))
    by_slot = {}
    for value in sorted(numbered):
        by_slot.setdefault(value >> 57, []).append(value)
    result = []
    for slot, values in sorted(by_slot.items()):
        chosen = sorted(values[:2], key=lambda v: v & (2**om.POSITION_BITS - 1))
        h = long_hash(42, *(long(v >> om.POSITION_BITS) for v in chosen))
        result.append(slot << om.HASH_BITS | h & (2**om.HASH_BITS - 1))
    return result


def test_slots_against_a_plain_version(spark):
    rows = om.with_slots(documents(spark).select("doc_id", "text"), "text", "slots").collect()
    for r in rows:
        assert r.slots == plain_slots(r.text), (r.text or "")[:40]


def test_compare_edited(spark):
    rows = [(i, t or "") for i, t, _ in texts()]
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(f"{'-' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()))
    following = {r: distinct[(k + 1) % len(distinct)] for k, r in enumerate(distinct)}
    expected = []
    for r in rows:
        text, after = r[1], following[r][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, new, other = (plain_slots(t) for t in (text, edited, after))
        near = lambda a, b: len(set(a) & set(b)) / max(len(a), len(b)) if a or b else 1.0
        digits = lambda slots: "".join(f"{s:06x}" for s in slots)
        expected.append((-1 if r[0] is None else r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(new), near(own, new), near(own, other)))
    found = om.compare_edited(documents(spark)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:7]) for r in found) == sorted(expected)


def test_fingerprints_are_sensitive_to_order(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    shuffled = sorted(words, key=lambda w: hashlib.md5(w.encode()).hexdigest())
    docs = documents(spark, [(1, " ".join(words), None), (2, " ".join(moved), None), (3, " ".join(shuffled), None), (4, " ".join(words), None)])
    slots = {r.doc_id: r.slots for r in om.with_slots(docs.select("doc_id", "text"), "text", "slots").collect()}
    assert slots[1] == slots[4]
    near = {i: len(set(slots[1]) & set(slots[i])) / om.SLOTS for i in (2, 3)}
    assert 0.2 < near[2] < 0.9 and near[3] < 0.1  # the same k-mers but for the seam, half of them in another order
    prints = {r.doc_id: r.fingerprint for r in om.fingerprints(docs).collect()}
    assert prints[1] == prints[4] != prints[2]


def plain_filled_slots(text):
    words = WORD.findall(text or "")
    if not words:
        return []
    hashes = [long_hash(42, w) for w in words]
    kmers = sorted(packed(long_hash(42, *map(long, hashes[i : i + om.K])), i) for i in range(max(1, len(words) - om.K + 1)))
    numbered, seen = [], {}
    for value in kmers:
        h = value >> om.POSITION_BITS
        occurrence = seen[h] = seen.get(h, -1) + 1
        numbered.append(packed(long_hash(42, long(h), (occurrence, 4)), value & (2**om.POSITION_BITS - 1)))
    result = []
    for slot in range(om.SLOTS):
        # The slot's start becomes the least hash of all.
        chosen = sorted(numbered, key=lambda v: (v - (slot << 57)) % 2**63)[:2]
        h = long_hash(42, *(long(v >> om.POSITION_BITS) for v in sorted(chosen, key=lambda v: v & (2**om.POSITION_BITS - 1))))
        result.append(slot << om.HASH_BITS | h & (2**om.HASH_BITS - 1))
    return result


def test_filled_slots_against_a_plain_version(spark):
    rows = [r for r in texts() if len(r[1] or "") < 20_000]
    for r in om.with_slots(documents(spark, rows).select("doc_id", "text"), "text", "slots", fill=True).collect():
        assert r.slots == plain_filled_slots(r.text), (r.text or "")[:40]


def test_short_texts_are_sensitive_to_order(spark):
    sizes, each = (20, 40, 60, 100, 200), 30
    rows = []
    for n in sizes:
        for k in range(each):
            words = [f"w{n}x{k}x{i}" for i in range(n)]
            rows += [(len(rows), " ".join(words), None), (len(rows) + 1, " ".join(words[n // 2 :] + words[: n // 2]), None)]

    # Both halves swapped: of the pairs of k-mers, a half keeps its order, and fewer have both.
    slots = {r.doc_id: set(r.slots) for r in om.with_slots(documents(spark, rows).select("doc_id", "text"), "text", "slots", fill=True).collect()}
    pairs = [len(slots[i] & slots[i + 1]) / max(len(slots[i]), len(slots[i + 1])) for i in range(0, len(rows), 2)]
    near = {n: sum(pairs[k * each : (k + 1) * each]) / each for k, n in enumerate(sizes)}
    assert all(0.15 < x < 0.55 for x in near.values()), near


def test_query_fills_slots(spark, tmp_path):
    documents(spark, [(1, "a b c d e f g h", None), (2, "a b c", None), (3, "", None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.fingerprint for r in op9_order_minhash(spark, str(tmp_path)).collect()}
    assert {i: len(f) for i, f in rows.items()} == {1: 6 * om.SLOTS, 2: 6 * om.SLOTS, 3: 0}


def test_texts_without_blanks(spark):
    chars = "".join(chr(0x4E00 + i) for i in range(300))
    latin = "".join(chr(97 + int(d, 16)) for d in hashlib.sha512(b"x").hexdigest() * 3)
    spaced = " ".join(f"w{i}" for i in range(300))
    rows = [(1, chars, None), (2, latin, None), (3, spaced, None), (4, "a" * om.LONG_WORD, None), (5, "", None)]
    near = {r.doc_id: r.near_edited for r in om.compare_edited(documents(spark, rows), fill=True, split=True).collect()}
    assert near[1] > 0.2 and near[2] > 0.2, near
    docs = documents(spark, [*rows, (6, " ".join(chars), None), (7, " ".join(latin), None)]).select("doc_id", "text")
    slots = {r.doc_id: r.slots for r in om.with_slots(docs, "text", "slots", fill=True, split=True).collect()}
    assert slots[1] == slots[6] and slots[2] == slots[7] and slots[5] == []
    assert slots[3] == plain_filled_slots(spaced) and slots[4] == plain_filled_slots("a" * om.LONG_WORD)


def test_fingerprints_of_one_and_no_document(spark):
    one = om.compare_edited(documents(spark, [(5, "a b c d", None)])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert om.compare_edited(documents(spark, [])).collect() == []


def test_no_python_in_plans(spark):
    plan = om.compare_edited(documents(spark))._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas"))
    assert F is not None
