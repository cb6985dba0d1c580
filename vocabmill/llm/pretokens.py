"""Words of a text as the tokenizer sees them, by a small transducer over character classes.

The tokenizer of ``word_bpe_49k.json`` brings a text to NFC, lower-cases it one
character at a time and takes, from left to right: an apostrophe with ``s t re
ve m ll d``, a run of letters, one number character, or a run of anything else
that isn't white space. A deterministic transducer with seven states says for
each character whether a word starts there. A text is cut into chunks of equal
length. The map of a chunk, from the state before it to the state after it, is
found for all chunks at once; the maps are composed by a parallel prefix scan,
which gives the state before each chunk; then all chunks run again, with one
state each, and mark where words start.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Stand for the special tokens in a prepared text. No text from a table holds surrogates.
SPECIAL_MARKS = {"<|startoftext|>": "\ud800", "<|endoftext|>": "\ud801"}
#: Characters with the property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters in a chunk.
CHUNK = 256

SPACE, NUMBER, OTHER, QUOTE, SHORT, R, V, L, E, LETTER = range(10)
START, WORD, RUN, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
STATES, CLASSES = 7, 10
#: What a transition emits: a word starts here; a word started at the character before.
HERE, BEFORE = 1, 2


def prepare(text: str) -> str:
    """Special tokens as marks; NFC; lower case, each character by itself."""
    if "<|" in text:
        for token, mark in SPECIAL_MARKS.items():
            text = text.replace(token, mark)
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # Python's lower() has a final form of sigma that depends on its neighbours.
    return text.replace("Σ", "σ").lower()


@functools.cache
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = SPACE
    for letter, kind in {"'": QUOTE, "s": SHORT, "t": SHORT, "m": SHORT, "d": SHORT, "r": R, "v": V, "l": L, "e": E}.items():
        table[ord(letter)] = kind
    for mark in SPECIAL_MARKS.values():
        table[ord(mark)] = NUMBER  # a word of its own
    return table


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and what is emitted, at ``state * CLASSES + class``."""
    state = np.zeros((STATES, CLASSES), np.uint8)
    emit = np.zeros((STATES, CLASSES), np.uint8)
    letters = (SHORT, R, V, L, E, LETTER)
    for s in (START, WORD):
        state[s, [SPACE, NUMBER, OTHER, QUOTE]] = START, START, RUN, QUOTED
        emit[s, [NUMBER, OTHER, QUOTE]] = HERE
        state[s, letters] = WORD
        emit[s, letters] = HERE if s == START else 0
    for s in (RUN, QUOTED):
        state[s, [SPACE, NUMBER, OTHER, QUOTE]] = START, START, RUN, RUN
        emit[s, NUMBER] = HERE
        state[s, letters] = WORD
        emit[s, letters] = HERE
    state[QUOTED, SHORT], emit[QUOTED, SHORT] = START, 0
    for letter, s, last in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        state[QUOTED, letter], emit[QUOTED, letter] = s, 0
        state[s], emit[s] = state[WORD], emit[WORD] | BEFORE
        state[s, last], emit[s, last] = START, 0
    return state.ravel(), emit.ravel()


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """State after each chunk (a row of ``classes``) for each state before it."""
    step, _ = transitions()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (len(classes), 1))
    at, width = 0, classes.shape[1]
    while at < width:
        maps = step[maps * np.uint8(CLASSES) + classes[:, at, None]]
        at += 1
        if at % 8 == 0 and (maps == maps[:, :1]).all():
            break
    state = maps[:, 0]
    if at < width:  # the same state, whatever came before
        for column in classes.T[at:]:
            state = step[state * np.uint8(CLASSES) + column]
        maps = np.repeat(state[:, None], STATES, 1)
    return maps


def scan(maps: np.ndarray) -> np.ndarray:
    """Composition of each map with all before it, in log2(n) rounds."""
    done, reach = maps.copy(), 1
    while reach < len(done):
        done[reach:] = np.take_along_axis(done[reach:], done[:-reach].astype(np.intp), 1)
        reach *= 2
    return done


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a prepared text that ends with white space, and where words start and end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = class_table()[codes]
    chunks = -(-len(codes) // CHUNK)
    padded = np.full(chunks * CHUNK, SPACE, np.uint8)
    padded[: len(codes)] = classes
    rows = padded.reshape(chunks, CHUNK)
    after = scan(chunk_maps(rows))[:, START]
    state = np.concatenate(([np.uint8(START)], after[:-1]))
    step, emit = transitions()
    emitted = np.empty((CHUNK, chunks), np.uint8)
    for at, column in enumerate(np.ascontiguousarray(rows.T)):
        key = state * np.uint8(CLASSES) + column
        emitted[at] = emit[key]
        state = step[key]
    flags = np.ascontiguousarray(emitted.T).ravel()[: len(codes)]
    starting = (flags & HERE).astype(bool)
    starting[:-1] |= (flags[1:] & BEFORE).astype(bool)
    bounds = np.flatnonzero(starting | (classes == SPACE))
    first = np.flatnonzero(starting[bounds])
    return codes, bounds[first], bounds[first + 1]
