"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss.

The patterns give the base spans; their letters are ASCII's. The field tags every token of a text as the begin
of a secret, inside one or outside (B, I, O), from the token's shape, the neighbouring words and features of the
whole text, decoded by Viterbi. Tokens are runs of signs and runs of other characters without white space, so
that the name, the sign and the value of NAME="value" are tokens of their own. Outside has the score 0 and outside
after outside costs nothing, so that only stretches of tokens that could gain anything have to be decoded: a
token is in such a stretch if some interval around it has a positive sum of upper bounds of what its tokens can
gain. All others are outside in the best labelling, so that the result is that of decoding the whole text.

The weights are trained by this module on texts that it makes itself (train()), and kept beside it.

Defined results: a null text and an empty one have no spans; spans of the field that touch a base span are left
out; spans are code points, end exclusive; equal starts go by the order of KINDS, then by the end. Texts are scanned
whole, whatever their length: a very long one is tokenised in blocks and takes about 50 bytes a token in a
worker. Repeated rows are scanned each; extra columns need no special case; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
MASK = "[secret]"

_SIGNS = r"""=:"'`<>(){}\[\]|&;,@?"""
#: A token with the white space character before it, if there is one.
TOKEN = re.compile(rf"\s?(?:[^\s{_SIGNS}]+|[{_SIGNS}]+)")
_SIGN_CHARS = _SIGNS.replace("\\", "")
_IS_SIGN = re.compile(rf"[{_SIGNS}]+")
#: Signs after a secret's last token that pad it.
_PADDING = re.compile(rf"={{1,2}}(?![^\s{_SIGNS}])")
_SPACE = re.compile(r"\s")

HINTS = ("password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "token", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "private", "signature", "sig", "access", "login", "pin")
SAFE = ("commit", "sha", "checksum", "md5", "uuid", "guid", "id", "isbn", "version", "http", "https", "www", "image", "file", "path", "mail", "email", "order", "invoice", "tracking", "doi", "phone", "ref", "class", "name", "host", "url", "build", "page", "serial", "figure", "table")
LINKS = ("is", "are", "was", "to", "of", "for", "with", "as", "my", "your", "our", "the", "a", "an", "and", "or", "use", "set", "not", "be", "must", "should", "in", "on", "at", "by", "if", "begin", "end", "user", "username")
PREFIXES = ("ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-", "npm_", "AKIA", "ASIA", "ya29.", "SG.", "hf_", "dop_v1_")
MIXES = ("edge", "sign", "lower", "title", "upper", "mixed", "digits", "hex", "alnum_lower", "alnum_upper", "alnum_mixed", "joined", "path", "symbols", "other")
SIGN_KINDS = ("assign", "assign_quote", "colon", "colon_quote", "quote", "separator", "open", "close", "angle", "at", "ask", "other_sign")

LABELS = "OBI"
#: Places of the neighbours whose class counts, and the states of what stands before.
PLACES = (-3, -2, -1, 1, 2)
STATES = ("none", "assigned_hint", "hint", "linked_hint", "near_hint", "assigned")
FILES = ("prose", "code", "env", "code_env")

#: From how many characters on a token is long.
LONG = 14
#: Tokens, and characters of tokens, that a worker remembers (in scan(), and in redacted(), whose workers go on to other
#: work of a pipeline); characters of the texts looked at together, and tokens looked up together.
TOKENS_HELD, CHARS_HELD = 700_000, 12_000_000
TOKENS_BESIDE, CHARS_BESIDE = 200_000, 4_000_000
BLOCK_CHARS, TOKENS_AT_ONCE = 400_000, 50_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# --- tokens


def core_of(token: str) -> str:
    """A token without the white space before it and the stops after it."""
    token = token.strip()
    return token.rstrip(".!…") or token


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER, _HEXES, _PLAIN = re.compile(r"[0-9][0-9.,%-]*"), re.compile(r"[0-9a-f]{7,}|[0-9A-F]{7,}"), re.compile(r"[\w+/=.~-]+")
_JOINED = re.compile(r"[^\W\d_]+(?:['’_.-]+[^\W\d_]+)+")
_PATH = re.compile(r"~?/.*|.*/.*\.\w{1,5}|\.{1,2}/.*|[\w.-]+\.(?:com|org|net|io|dev|html?|py|js|txt|json|ya?ml|png|jpe?g|md|log|cfg|conf|example)(?:/.*)?")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def mix_of(s: str) -> str:
    """The class of characters that a token is made of, one of MIXES."""
    if s.isalpha():
        if s[1:] == s[1:].lower():
            return "title" if s[0].isupper() else "lower"
        return "upper" if s.isupper() else "mixed"
    if _IS_SIGN.fullmatch(s):
        return "sign"
    if _NUMBER.fullmatch(s):
        return "digits"
    if _PATH.fullmatch(s):
        return "path"
    if _JOINED.fullmatch(s):
        return "joined"
    if _HEXES.fullmatch(s):
        return "hex"
    if _PLAIN.fullmatch(s) and any(map(str.isalpha, s)):
        letters = [c for c in s if c.isalpha()]
        if not any(map(str.isdigit, s)):
            return "symbols"
        return "alnum_lower" if all(map(str.islower, letters)) else "alnum_upper" if all(map(str.isupper, letters)) else "alnum_mixed"
    return "symbols" if any(map(str.isalnum, s)) else "other"


def sign_kind(s: str) -> str:
    quoted = s[-1] in "\"'`"
    if "=" in s:
        return "assign_quote" if quoted else "assign"
    if ":" in s:
        return "colon_quote" if quoted else "colon"
    last = s[-1]
    return "quote" if quoted else "separator" if last in ",;&|" else "open" if last in "({[" else "close" if last in ")}]" else "angle" if last in "<>" else "at" if last == "@" else "ask" if last == "?" else "other_sign"


_LINKED_WORDS = {w: f"link:{w}" for w in LINKS}
_NAMES = re.compile("|".join(sorted({*HINTS, *SAFE}, key=len)), re.IGNORECASE | re.ASCII)


def _named(s: str, names: tuple[str, ...]) -> str:
    """The first of the names that a part of the token is, or begins or ends with (names of four letters and more)."""
    if len(s) > 40 or sum(map(str.isdigit, s)) * 4 > len(s):
        return ""
    parts = [p.lower() for p in _PARTS.findall(s)]
    for name in names:
        if any(p == name or len(name) >= 4 and len(p) <= len(name) + 6 and (p.startswith(name) or p.endswith(name)) for p in parts):
            return name
    return ""


def _size(n: int) -> int:
    return 0 if n < 6 else 1 if n < 12 else 2 if n < 20 else 3


COARSE = tuple(f"{m}{k}" for m in MIXES for k in range(4))
CLASSES = ("edge", *(f"sign:{k}" for k in SIGN_KINDS), *(f"hint:{h}" for h in HINTS), "safe", *(f"link:{w}" for w in LINKS), *(f"mix:{m}" for m in MIXES))
_COARSE_AT, _CLASS_AT = {c: i for i, c in enumerate(COARSE)}, {c: i for i, c in enumerate(CLASSES)}
_HINTED = np.array([c.startswith("hint:") for c in CLASSES])
_QUOTE = np.array([c in ("sign:quote", "sign:angle") for c in CLASSES])
_ASSIGN = np.array([c.startswith(("sign:assign", "sign:colon")) for c in CLASSES])
_LINKED = np.array([c in ("link:is", "link:was", "link:as", "link:for", "link:to", "link:with") for c in CLASSES])


def class_of(core: str, mix: str) -> str:
    """What a token is to its neighbours, one of CLASSES."""
    if mix == "sign":
        return f"sign:{sign_kind(core)}"
    if link := _LINKED_WORDS.get(core.lower()):
        return link
    if _NAMES.search(core):
        if hint := _named(core, HINTS):
            return f"hint:{hint}"
        if _named(core, SAFE):
            return "safe"
    return f"mix:{mix}"


class _Kinds(dict):
    """Code point -> d, u, l or s: digit, upper case, other letter, anything else."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"
        return kind


_KINDS = _Kinds()
_VOWELS = re.compile("[aeiouyäöüéèêàóíáúñ]", re.IGNORECASE)
_VOWELLESS = re.compile("[b-df-hj-np-tv-xz]+", re.IGNORECASE | re.ASCII)
_IS_CONSONANT = np.array([bool(_VOWELLESS.match(chr(c))) for c in range(128)] + [False])
_MARKS = re.compile(r"[!#$%^*~\\]")


def _consonants(core: str) -> int:
    """The longest run of consonants, 8 at most."""
    return min(8, max(map(len, _VOWELLESS.findall(core)), default=0))


#: What stands before a token: the begin of a line, other white space or nothing.
LEADS = ("line", "space", "glued")


class _Leads(dict):
    def __missing__(self, c: str) -> int:
        at = self[c] = 0 if c in "\n\r" else 1 if c.isspace() else 2
        return at


_LEAD_AT = _Leads()


def core_features(core: str) -> tuple[list[str], str, str]:
    """The features of a token's own characters, its coarse shape and its class."""
    mix, n = mix_of(core), len(core)
    coarse, kind = f"{mix}{_size(n)}", class_of(core, mix)
    out = ["bias", f"mix:{mix}", f"is:{kind}", f"mix:{mix}/len:{min(n // 4, 12)}"]
    if mix == "sign":
        return out, coarse, kind
    long, consonants = int(n >= LONG), _consonants(core)
    if mix in ("lower", "title") and not long:
        return [*out, f"natural/consonants:{consonants}"], coarse, kind
    kinds = core.translate(_KINDS)
    digits, upper, letters = kinds.count("d"), kinds.count("u"), len(kinds) - kinds.count("s") - kinds.count("d")
    changes = sum(1 for _ in groupby(kinds)) - 1
    out += [
        f"digits:{min(int(8 * digits / n), 6)}", f"case:{int(upper > 1)}{int(letters - upper > 1)}{int(digits > 0)}", f"changes:{min(int(10 * changes / n), 7)}/long:{long}",
        f"vowels:{min(int(8 * len(_VOWELS.findall(core)) / max(1, letters)), 5)}/long:{long}", f"consonants:{consonants}",
    ]
    if n >= 6:
        out.append(f"entropy:{min(int(2 * entropy(core)), 11)}/long:{long}")
    out += [f"{name}:{min(k, 4)}" for name, sign in (("dots", "."), ("slashes", "/"), ("dashes", "-"), ("under", "_"), ("plus", "+")) if (k := core.count(sign))]
    if k := len(_MARKS.findall(core)):
        out.append(f"marks:{min(k, 3)}/alnum:{int(digits + letters > k)}")
    if core.startswith(PREFIXES):
        out.append(f"prefix/len:{min(n // 8, 3)}")
    if _UUID.fullmatch(core):
        out.append("uuid")
    if core[0] in "$%#" or core.endswith("%"):
        out.append("variable")
    if not core.isascii():
        out.append("not_ascii")
    if len(set(core)) * 4 <= n:
        out.append("few_characters")
    if core.startswith("-"):
        out.append("option")
    return out, coarse, kind


def shape_features(token: str) -> tuple[list[str], str, str]:
    """core_features() of a token, with what stands before it."""
    own, coarse, kind = core_features(core_of(token))
    return [f"lead:{LEADS[_LEAD_AT[token[0]]]}", *own], coarse, kind


def file_of(text: str) -> int:
    """The features of a whole text, as a place in FILES."""
    code = "{" in text or "();" in text or "=>" in text or "</" in text
    return int(code) + 2 * int("export " in text or "\n[" in text)


def _before(kinds: np.ndarray) -> np.ndarray:
    """The state (place in STATES) of each token from the classes of those before it; kinds has 4 more in front."""
    at = lambda k: kinds[4 - k : len(kinds) - k]
    k1, k2, k3, k4 = at(1), at(2), at(3), at(4)
    sign1, quote1 = _ASSIGN[k1], _QUOTE[k1]
    assigned = sign1 & _HINTED[k2] | quote1 & (_ASSIGN[k2] & _HINTED[k3] | _HINTED[k2]) | sign1 & _QUOTE[k2] & _HINTED[k3]
    near = _HINTED[k2] | _HINTED[k3] | _HINTED[k4]
    linked = _LINKED[k1] & near
    out = np.where(sign1 | quote1 & _ASSIGN[k2], 5, 0)
    out = np.where(near, 4, out)
    out = np.where(linked, 3, out)
    out = np.where(_HINTED[k1], 2, out)
    return np.where(assigned, 1, out).astype(np.int16)


# --- the field


class Field:
    """Weights of a linear-chain field by feature, for B and I; those of O, and of O after O, are 0."""

    def __init__(self, weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.weights = weights or {}
        self.moves = np.zeros((3, 3)) if moves is None else np.array(moves, float)
        self.moves[0, 2], self.moves[0, 0] = -1e6, 0.0
        w = lambda name: self.weights.get(name, (0.0, 0.0))
        self.places = [np.array([w(f"at{p}:{c}") for c in CLASSES]) for p in PLACES]
        self.states = np.array([w(f"before:{s}/{c}") for s in STATES for c in COARSE])
        self.files = np.array([w(f"text:{f}/{c}") for f in FILES for c in COARSE])
        m = self.moves
        self.most = (TOKENS_HELD, CHARS_HELD)
        self.reach = np.array([max(m[0, 1], m[1, 1], m[2, 1]), max(m[1, 2], m[2, 2])]) + max(0.0, m[1, 0], m[2, 0])
        self.forget()

    def forget(self) -> None:
        self.index, self.cores, self.alike, self.chars = {}, {}, {}, 0
        self.shapes, self.kinds, self.coarse = np.zeros((0, 2)), np.zeros(0, np.uint8), np.zeros(0, np.uint8)

    def _core(self, core: str) -> tuple[float, float, int, int]:
        known = self.cores.get(core)
        if known is None:
            known = self.cores[core] = self._scored(core)
        return known

    def _short_words(self, words: list[str]) -> np.ndarray:
        """What _scored() gives for each of some short natural words. Those without a name in them and that are no links differ in
        three features alone, and are looked at side by side; they are most of what is new."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = "\n".join(words)
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)
        place = np.arange(len(codes))
        run = place - np.maximum.accumulate(np.where(_IS_CONSONANT[codes], -1, place))
        consonants = np.minimum(np.maximum.reduceat(run, starts), 8)
        title = np.fromiter((w[0].isupper() for w in words), np.int64, len(words))
        alone = np.fromiter((w.lower() in _LINKED_WORDS for w in words), bool, len(words))
        alone[[int(np.searchsorted(starts, m.start(), side="right")) - 1 for m in _NAMES.finditer(text)]] = True
        kinds, first, of = np.unique((sizes * 2 + title) * 16 + consonants + np.where(alone, (np.arange(len(words)) + 1) << 20, 0), return_index=True, return_inverse=True)
        table = []
        for kind, i in zip(kinds.tolist(), first.tolist(), strict=True):
            known = self.alike.get(kind)
            if known is None:
                known = self._scored(words[i])
                if kind < 1 << 20:
                    self.alike[kind] = known
            table.append(known)
        return np.array(table)[of]

    def _scored(self, core: str) -> tuple[float, float, int, int]:
        names, coarse, kind = core_features(core)
        w = [x for x in map(self.weights.get, names) if x]
        return sum(x[0] for x in w), sum(x[1] for x in w), _COARSE_AT[coarse], _CLASS_AT[kind]

    def learn(self, tokens: list[str]) -> np.ndarray:
        """Each token's place in the tables of what is known of tokens."""
        new = list(set(tokens).difference(self.index))
        if len(self.index) + len(new) > self.most[0] or self.chars > self.most[1]:
            self.forget()
            new = list(set(tokens))
        if new:
            cores = list(map(core_of, new))
            short = np.fromiter((len(c) < LONG and c.isalpha() and c[1:] == c[1:].lower() for c in cores), bool, len(cores))
            table = np.zeros((len(new), 4))
            if short.any():
                table[short] = self._short_words([c for c, is_short in zip(cores, short.tolist(), strict=True) if is_short])
            if not short.all():
                table[~short] = [self._core(c) for c, is_short in zip(cores, short.tolist(), strict=True) if not is_short]
            lead = np.array([self.weights.get(f"lead:{x}", (0.0, 0.0)) for x in LEADS])[[_LEAD_AT[t[0]] for t in new]]
            self.shapes = np.concatenate([self.shapes, table[:, :2] + lead])
            self.coarse = np.concatenate([self.coarse, table[:, 2].astype(np.uint8)])
            self.kinds = np.concatenate([self.kinds, table[:, 3].astype(np.uint8)])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.chars += sum(map(len, new))
        return np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))

    def gains(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What B and I score at each token of the texts, and where each text's tokens begin; four places that
        belong to no token stand before each text and after the last, at -inf."""
        shapes, kinds, coarse, sizes, held = [], [], [], [], []

        def look_up() -> None:
            at = self.learn(held)
            shapes.append(self.shapes[at])
            kinds.append(self.kinds[at])
            coarse.append(self.coarse[at])
            held.clear()

        for text in texts:
            n = 0
            for low, high in _blocks(text):
                found = TOKEN.findall(text, low, high)
                n += len(found)
                held += found
                if len(held) >= TOKENS_AT_ONCE:
                    look_up()
            sizes.append(n)
        if held:
            look_up()
        starts = np.cumsum([4, *[n + 4 for n in sizes]])
        real = np.zeros(int(starts[-1]), bool)
        for s, n in zip(starts, sizes, strict=False):
            real[s : s + n] = True
        total, k, c = np.full((len(real), 2), -np.inf), np.zeros(len(real), np.uint8), np.concatenate(coarse) if coarse else np.zeros(0, np.uint8)
        k[real] = np.concatenate(kinds) if kinds else 0
        state = _before(np.concatenate([np.zeros(4, np.uint8), k]))[real]
        score = np.concatenate(shapes) if shapes else np.zeros((0, 2))
        score += self.states[state.astype(np.int64) * len(COARSE) + c]
        score += self.files[np.repeat([file_of(t) for t in texts], sizes).astype(np.int64) * len(COARSE) + c]
        for p, table in zip(PLACES, self.places, strict=True):
            score += table[np.roll(k, -p)[real]]
        total[real] = score
        return total, starts[:-1]

    def live(self, gains: np.ndarray) -> np.ndarray:
        """Which places can be other than O in the best labelling: those with an interval around them whose upper
        bounds have a positive sum."""
        bound = (gains + self.reach).max(axis=1)
        wall = -1.0 - np.maximum(bound, 0).sum()
        sums = np.cumsum(np.maximum(bound, wall))
        before = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
        ahead = np.maximum.accumulate(sums[::-1])[::-1]
        return (ahead - before > -1e-9 * (1 - sums.min())) & np.isfinite(bound)

    def worth(self, gains: np.ndarray, lows: np.ndarray, highs: np.ndarray, most: int = 64) -> np.ndarray:
        """Which stretches can score more than all O does, by the best scores of all of them side by side; those of more than
        `most` tokens are taken to."""
        sizes, m = highs - lows, self.moves
        out = sizes > most
        at = np.flatnonzero(~out)
        best = np.tile([0.0, -np.inf, -np.inf], (len(at), 1))
        for t in range(int(sizes[at].max()) if len(at) else 0):
            on = np.flatnonzero(sizes[at] > t)
            g, old = gains[lows[at[on]] + t], best[on]
            come = (old[:, :, None] + m).max(axis=1)
            come[:, 1:] += g
            best[on] = come
        out[at] = (best + m[:, 0]).max(axis=1) > 0
        return out

    def viterbi(self, gains: np.ndarray) -> str:
        """The best labels of a stretch with O on both sides; ties go to O, then to B."""
        m, back = self.moves.tolist(), []
        best = [m[0][0], m[0][1] + float(gains[0, 0]), m[0][2] + float(gains[0, 1])]
        for b, i in gains[1:].tolist():
            come = [max(range(3), key=lambda y, z=z: best[y] + m[y][z]) for z in range(3)]  # noqa: B023
            best = [best[come[0]] + m[come[0]][0], best[come[1]] + m[come[1]][1] + b, best[come[2]] + m[come[2]][2] + i]
            back.append(come)
        at = max(range(3), key=lambda y: best[y] + m[y][0])
        out = [at]
        for come in reversed(back):
            at = come[at]
            out.append(at)
        return "".join(LABELS[y] for y in reversed(out))

    def labels(self, texts: list[str]) -> list[list[tuple[int, str]]]:
        """For each text, (token's place, labels) of the stretches that were decoded and aren't all O."""
        gains, starts = self.gains(texts)
        marked = np.flatnonzero(np.diff(np.concatenate([[0], self.live(gains).astype(np.int8), [0]])))
        lows, highs = marked[::2], marked[1::2]
        worth = self.worth(gains, lows, highs)
        out: list[list[tuple[int, str]]] = [[] for _ in texts]
        for low, high in zip(lows[worth].tolist(), highs[worth].tolist(), strict=True):
            found = self.viterbi(gains[low:high])
            if "B" in found:
                text = int(np.searchsorted(starts, low, side="right")) - 1
                out[text].append((low - int(starts[text]), found))
        return out


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Where the blocks of a text begin and end, cut before white space."""
    low = 0
    while low < len(text):
        cut = _SPACE.search(text, low + BLOCK_CHARS) if len(text) - low > BLOCK_CHARS else None
        high = cut.start() if cut else len(text)
        yield low, high
        low = high


def _places(text: str, found: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """The code points of the tagged tokens: a span from each B through its I."""
    matches = ((m.start(), m.end(), m.group()) for low, high in _blocks(text) for m in TOKEN.finditer(text, low, high))
    out, at = [], 0
    for first, labels in found:
        for label, (start, end, token) in zip(labels, islice(matches, first - at, first - at + len(labels)), strict=True):
            begin = start + len(token) - len(token.lstrip())
            end = begin + len(core_of(token))
            if label == "B":
                out.append((begin, end))
            elif label == "I":
                out[-1] = (out[-1][0], end)
        at = first + len(labels)
    # Signs at a span's end are part of it as padding only.
    ends = [(a, a + len(text[a:b].rstrip(_SIGN_CHARS))) if text[a:b].strip(_SIGN_CHARS) else (a, b) for a, b in out]
    return [(a, m.end() if (m := _PADDING.match(text, b)) else b) for a, b in ends]


def crf_spans(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    return [_places(t, found) if found else [] for t, found in zip(texts, field.labels(texts), strict=True)]


def spans(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and all its spans: (start, kind, end) in order."""
    whole = [t or "" for t in texts]
    out = []
    for text, found in zip(whole, crf_spans(whole, field), strict=True):
        base = base_spans(text)
        more = [(a, 3, b) for a, b in found if not any(s < b and a < e for s, _, e in base)]
        out.append((base, sorted(base + more)))
    return out


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted_text(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by a mask; overlapping spans count as one."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(text: str | None, field: Field) -> str | None:
    return redacted_text(text, spans([text], field)[0][1]) if text else text


@lru_cache(maxsize=1)
def trained() -> Field:
    kept = json.loads((Path(__file__).parent / "secret_field.json").read_text())
    return Field(kept["weights"], kept["moves"])


# --- training


_COMMON = (
    "the of and a to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out"
    " many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who its now find long down day did get come made may part server client"
    " request value config setting deploy please check update required rotate store never shared missing expired invalid stored hashed reset field button page session cookie header manager database service account production"
).split()
_SYLLABLES = ("th", "er", "an", "tion", "le", "que", "ing", "sch", "ment", "os", "re", "ci", "ung", "ou", "be", "ar", "ungch", "stsch", "lich", "schutz", "gkeits", "rhyth", "ción", "éa", "ßen", "ñar", "ea", "a", "ó", "iou", "es", "ne", "it", "ea")
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HINT_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "auth", "bearer", "access_key", "private_key", "credential", "client_secret", "auth_token", "signature", "access_token", "secret_key", "secret_access_key", "pass", "pwd", "key", "refresh_token", "auth_key", "passphrase", "encryption_key", "sig_key", "login", "passcode")
_SAFE_NAMES = ("path", "file", "log_file", "home", "image", "image_name", "version", "build_id", "commit", "order", "ref", "url", "host", "class", "name", "title", "redirect", "page", "lang", "checksum", "tracking_id", "timeout", "region", "user", "mode")


class _Maker:
    """Random texts, each with the places of the secrets in it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, alphabet: str, a: int, b: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(a, b)))

    def made_word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def word(self) -> str:
        return self.r.choice(_COMMON) if self.r.random() < 0.6 else self.made_word()

    def prose(self, a: int, b: int) -> str:
        out = []
        for _ in range(self.r.randint(a, b)):
            w = self.word()
            p = self.r.random()
            out.append(w.title() if p < 0.1 else w + self.r.choice([".", ",", "!", "***", "$$$", "###", "&&&", ";", "?"]) if p < 0.2 else w.upper() if p < 0.22 else w)
        return " ".join(out)

    def long_secret(self) -> str:
        r, alnum = self.r, _LOW + _UP + _DIG
        return r.choice([
            lambda: self.pick(_DIG + "abcdef", 32, 64), lambda: self.pick(alnum, 16, 48), lambda: self.pick(alnum + "+/", 28, 64) + r.choice(["", "=", "=="]), lambda: "ghp_" + self.pick(alnum, 36, 36),
            lambda: r.choice(["sk_live_", "sk-", "pk_live_"]) + self.pick(alnum, 20, 40), lambda: "xoxb-" + self.pick(_DIG, 10, 12) + "-" + self.pick(alnum, 24, 24), lambda: "AIza" + self.pick(alnum + "-_", 35, 35),
            lambda: "eyJ" + self.pick(alnum, 15, 30) + ".eyJ" + self.pick(alnum, 30, 60) + "." + self.pick(alnum + "-_", 30, 43), lambda: "glpat-" + self.pick(alnum, 20, 20), lambda: "AKIA" + self.pick(_UP + _DIG, 16, 16),
            lambda: self.pick(_DIG + "ABCDEF", 32, 40), lambda: self.pick(_LOW + _UP, 16, 48), lambda: self.pick(_LOW, 20, 40), lambda: self.pick(_UP, 20, 40), lambda: "SG." + self.pick(alnum, 22, 22) + "." + self.pick(alnum, 43, 43), lambda: self.pick(_LOW + _DIG, 16, 40),
        ])()

    def short_secret(self) -> str:
        r = self.r
        return r.choice([
            lambda: self.pick(_LOW + _UP + _DIG, 6, 15), lambda: self.pick(_LOW + _DIG, 6, 15), lambda: self.made_word().title() + self.pick(_DIG, 2, 4) + r.choice("!#$%*"), lambda: self.pick(_LOW + _UP + _DIG + "!#$%^*", 8, 16),
            lambda: "-".join(self.word() for _ in range(r.randint(3, 5))), lambda: r.choice(_COMMON).replace("o", "0").replace("e", "3").replace("a", "4") + self.pick(_DIG, 1, 4) + r.choice(["", "!"]), lambda: self.pick(_LOW + _UP, 10, 16),
            lambda: self.word() + self.pick(_DIG, 2, 4), lambda: self.pick(_UP + _DIG, 8, 14),
        ])()

    def name(self, of: tuple[str, ...]) -> str:
        """A name of a setting, alone or of several words, in the cases that are in use."""
        r, words = self.r, []
        words = [*(self.word() for _ in range(r.choice([0, 0, 1, 1, 2]))), *r.choice(of).split("_")]
        form = r.random()
        return "_".join(words).upper() if form < 0.4 else "_".join(words).lower() if form < 0.7 else words[0].lower() + "".join(w.title() for w in words[1:]) if form < 0.9 else r.choice("-.").join(words).lower()

    def plain_value(self) -> str:
        r, parts = self.r, [self.word() for _ in range(self.r.randint(2, 4))]
        return r.choice([
            lambda: self.word(), lambda: "".join(parts), lambda: "_".join(parts), lambda: "-".join(parts), lambda: ".".join(parts), lambda: "".join(w.title() for w in parts), lambda: "/" + "/".join(parts) + "." + r.choice(["log", "txt", "py", "html"]),
            lambda: "_".join(parts).upper(), lambda: f"{self.word()}.example.com/{self.word()}/{self.word()}", lambda: r.choice("-_=*.#") * r.randint(3, 40), lambda: f"{self.word()}-{self.word()}-{self.pick(_DIG, 1, 4)}", lambda: self.pick(_DIG, 1, 6),
            lambda: "-".join(self.pick(_DIG + "abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: f"{self.word()}{self.word()}{self.pick(_DIG, 1, 3)}", lambda: r.choice(["true", "false", "null", "None", "localhost", "0.0.0.0", "us-east-1", "INFO", "utf-8"]),
            lambda: f"{parts[0]}({parts[1]})", lambda: f"os.environ[\"{self.name(_HINT_NAMES)}\"]", lambda: f"${{{self.name(_HINT_NAMES)}}}", lambda: f"<your-{parts[0]}>", lambda: f"{parts[0]}.{parts[1]}.{self.name(_HINT_NAMES)}", lambda: "********", lambda: f"{self.pick(_DIG, 1, 2)}.{self.pick(_DIG, 1, 2)}.{self.pick(_DIG, 1, 3)}",
        ])()

    def harmless(self) -> str:
        r, w, pick = self.r, self.made_word, self.pick
        return r.choice([
            lambda: f"{w()}.{pick(_DIG, 2, 3)}@{w()}{pick(_DIG, 1, 2)}.example.com", lambda: f"https://www.{w()}{w()}{pick(_DIG, 0, 3)}.com/{w()}/{w()}-{pick(_DIG, 3, 6)}.html?page={pick(_DIG, 1, 3)}", lambda: "version " + ".".join(pick(_DIG, 1, 3) for _ in range(3)) + r.choice(["", f"-{w()}{pick(_DIG, 1, 2)}"]),
            lambda: "commit " + pick(_DIG + "abcdef", 7, 40), lambda: "sha256 checksum " + pick(_DIG + "abcdef", 22, 64), lambda: "uuid " + "-".join(pick(_DIG + "abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: f"/usr/{w()}/{w()}{pick(_DIG, 1, 2)}/{w()}.{w()}.txt",
            lambda: f"{w()}{w()}{w()}{w()}{pick(_DIG, 0, 4)}", lambda: "ISBN 978-" + pick(_DIG, 1, 1) + "-" + pick(_DIG, 4, 4) + "-" + pick(_DIG, 4, 4) + "-X", lambda: f"order {pick(_UP, 1, 3)}{pick(_DIG, 4, 6)}-{pick(_DIG, 4, 10)}", lambda: f"{w().title()}{w().title()}{w().title()}{pick(_DIG, 0, 3)}",
            lambda: f"image_{w()}_{w()}_{pick(_DIG, 2, 8)}.jpeg", lambda: f"+1 ({pick(_DIG, 3, 3)}) 555-{pick(_DIG, 4, 4)}", lambda: f"{pick(_DIG, 4, 4)}-{pick(_DIG, 2, 2)}-{pick(_DIG, 2, 2)}T{pick(_DIG, 2, 2)}:{pick(_DIG, 2, 2)}:{pick(_DIG, 2, 2)}Z", lambda: f"doi 10.{pick(_DIG, 4, 4)}/{w()}.{w()}.{pick(_DIG, 4, 6)}",
            lambda: ".".join(pick(_DIG, 1, 3) for _ in range(4)), lambda: f"def {w()}_{r.choice(_HINT_NAMES)}(self, {w()}): return self.{r.choice(_HINT_NAMES)}", lambda: f"#{pick(_DIG + 'abcdef', 6, 6)}", lambda: f"model {pick(_UP, 1, 2)}{pick(_DIG, 2, 4)}{pick(_UP, 0, 1)}",
            lambda: f"{r.choice(_COMMON)} {pick(_DIG, 1, 2)}{r.choice(['th', 'px', 'kg', 'ms', 'GB', 'x'])}", lambda: f"{r.choice(_HINT_NAMES)} {r.choice(['is required', 'must not be empty', 'was reset by the user', 'for the service is stored elsewhere', 'of the account has expired', 'cannot be shared', 'manager', 'ring network', 'is too short', 'length should be 12'])}",
            lambda: f"the {r.choice(['secret', 'key', 'token', 'pass', 'access'])} {r.choice(['to success', 'ingredient', 'gesture', 'road', 'of the matter', 'to the city'])}", lambda: f"{self.name(_HINT_NAMES)}: str", lambda: f"if {r.choice(_HINT_NAMES)} == {w()}:", lambda: f"ticket {pick(_UP, 2, 4)}-{pick(_DIG, 2, 5)}", lambda: f"serial {pick(_UP + _DIG, 8, 12)}",
            lambda: pick("ACGT", 12, 40), lambda: f"{r.choice(['color', 'background', 'border-color'])}: #{pick(_DIG + 'abcdef', 6, 6)};", lambda: f"{w()}{r.choice(['***', '$$$', '###', '&&&', '%%%'])} {w()}{r.choice(['***', '$$$', '%%%'])}",
        ])()

    def piece(self) -> tuple[str, list[tuple[int, int]]]:
        """A piece of text and the places of its secrets."""
        r, text, found = self.r, "", []

        def put(secret: str) -> None:
            nonlocal text
            found.append((len(text), len(text) + len(secret)))
            text += secret

        kind = r.random()
        if kind < 0.16:  # told in prose or as a field
            hint = r.choice(_HINT_NAMES).replace("_", r.choice(["_", " ", ""]))
            text = r.choice([f"{hint} is ", f"{hint}: ", f"the {hint} for {self.word()} is ", f"my {hint} is ", f"{hint} = ", f'"{hint}": ', f"{hint} ", f"{hint} -> ", f"{hint} of {self.word()}: ", f"new {hint} : "])
            quote = r.choice(["", "", '"', "'", "`"])
            text += quote
            put(self.long_secret() if r.random() < 0.5 else self.short_secret())
            text += quote
        elif kind < 0.20:
            text = "Authorization: " + r.choice(["Bearer ", "Basic ", "token "])
            put(self.long_secret() if r.random() < 0.8 else self.short_secret())
        elif kind < 0.24:  # in an address
            text = f"{r.choice(['postgres', 'mysql', 'redis', 'amqp', 'https'])}://{self.made_word()}:"
            put(self.short_secret().replace("#", "").replace("!", "") if r.random() < 0.7 else self.pick(_LOW + _UP + _DIG, 16, 24))
            text += f"@{self.made_word()}.example.com:{self.pick(_DIG, 4, 4)}/{self.word()}"
        elif kind < 0.28:  # a known form alone
            put(r.choice(["ghp_" + self.pick(_LOW + _UP + _DIG, 36, 36), "sk_live_" + self.pick(_LOW + _UP + _DIG, 24, 32), "xoxb-" + self.pick(_DIG, 11, 11) + "-" + self.pick(_LOW + _UP + _DIG, 24, 24), "glpat-" + self.pick(_LOW + _UP + _DIG, 20, 20), "eyJ" + self.pick(_LOW + _UP + _DIG, 20, 30) + "." + self.pick(_LOW + _UP + _DIG, 40, 60) + "." + self.pick(_LOW + _UP + _DIG, 43, 43)]))
        elif kind < 0.32:  # a key over several lines
            text = "-----BEGIN " + r.choice(["RSA ", "EC ", ""]) + "PRIVATE KEY-----\n"
            lines = [self.pick(_LOW + _UP + _DIG + "+/", 64, 64) for _ in range(r.randint(1, 5))] + [self.pick(_LOW + _UP + _DIG + "+/", 12, 60)]
            put("\n".join(lines))
            text += r.choice(["", "==", "="]) + "\n-----END PRIVATE KEY-----"
        elif kind < 0.35:  # several words in quotes
            text = r.choice(["passphrase", "pass phrase", "recovery phrase", "seed phrase"]) + r.choice([": ", " = ", " is "]) + '"'
            put(" ".join(r.choice(_COMMON) for _ in range(r.randint(4, 12))))
            text += '"'
        elif kind < 0.60:  # settings and parameters of addresses, quoted or not
            address, quote = r.random() < 0.25, r.choice(["", "", "", '"', "'"])
            sign, text = ("=", f"https://{self.made_word()}.example/{self.made_word()}?") if address else (r.choice(["=", "=", "=", ":", " = ", ": ", " := ", "=> "]), r.choice(["", "\n", "export ", "set ", "--", "- "]))
            for i in range(r.randint(1, 4)):
                hidden = r.random() < 0.5
                text += ("" if i == 0 else "&" if address else r.choice(["\n", "\n", " ", ";", "; ", ", "])) + self.name(_HINT_NAMES if hidden else _SAFE_NAMES if r.random() < 0.8 else _HINT_NAMES) + sign + ("" if address else quote)
                if hidden:
                    put(self.long_secret() if r.random() < 0.65 else self.short_secret())
                else:
                    text += self.plain_value()
                text += "" if address else quote
        elif kind < 0.64:
            text = f"--{r.choice(['password', 'token', 'api-key', 'secret', 'pass'])} "
            put(self.long_secret() if r.random() < 0.5 else self.short_secret())
        elif kind < 0.67:
            tag = r.choice(["password", "secretKey", "accessToken", "api-key"])
            text = f"<{tag}>"
            put(self.long_secret() if r.random() < 0.6 else self.short_secret())
            text += f"</{tag}>"
        elif kind < 0.74:
            text = self.plain_value()
        else:
            text = self.harmless()
        return text, found


def examples(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans of the secrets in them, made up at random."""
    make = _Maker(seed)
    r = make.r
    for _ in range(n):
        if r.random() < 0.25:  # nothing but prose, or words over and over
            again = lambda: " ".join([make.word() + r.choice(['', '', ',', '.'])] * r.randint(3, 60))
            yield " ".join(make.prose(10, 90) if r.random() < 0.5 else again() for _ in range(r.randint(1, 6))), []
            continue
        text, found = r.choice(["", "", "{ ", "export ", "\n[" + make.word() + "]\n"]) + make.prose(1, 14) + r.choice([" ", "\n"]), []
        for _ in range(r.randint(1, 4)):
            piece, own = make.piece()
            found += [(len(text) + a, len(text) + b) for a, b in own]
            text += piece + r.choice([" ", ", ", ".\n", "\n", "\n", " " + make.prose(1, 10) + " "]) + make.prose(1, 12) + r.choice([" ", "\n", ". "])
        yield text, found


def _sequence(text: str, found: list[tuple[int, int]]) -> tuple[list[list[str]], list[int]]:
    """The features and the labels of a text's tokens."""
    tokens = [(m.start() + len(m.group()) - len(m.group().lstrip()), m.group()) for m in TOKEN.finditer(text)]
    shapes = [shape_features(t) for _, t in tokens]
    kinds = [k for _, _, k in shapes]
    state = _before(np.array([0] * 4 + [_CLASS_AT[k] for k in kinds], np.uint8))
    file, rows, labels, last = FILES[file_of(text)], [], [], -1
    for i, ((start, _), (own, coarse, _)) in enumerate(zip(tokens, shapes, strict=True)):
        near = [f"at{p}:{kinds[i + p] if 0 <= i + p < len(kinds) else 'edge'}" for p in PLACES]
        rows.append([*own, *near, f"before:{STATES[state[i]]}/{coarse}", f"text:{file}/{coarse}"])
        at = next((n for n, (a, b) in enumerate(found) if a <= start < b), -1)
        labels.append(0 if at < 0 else 2 if at == last else 1)
        last = at
    return rows, labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def chances(scores: np.ndarray, moves: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts side by side (scores: text x place x label; real: which places are tokens, the first ones), the chance of each label
    at each place, and the expected number of each move, the moves from and to the O outside of a text included."""
    n, t, _ = scores.shape
    fore, hind = np.zeros((n, t, 3)), np.zeros((n, t, 3))
    fore[:, 0] = moves[0] + scores[:, 0]
    for i in range(1, t):
        fore[:, i] = np.where(real[:, i, None], _log_sum(fore[:, i - 1, :, None] + moves, 1) + scores[:, i], fore[:, i - 1])
    ends = np.broadcast_to(moves[:, 0], (n, 3))
    hind[:, t - 1] = ends
    for i in range(t - 2, -1, -1):
        hind[:, i] = np.where(real[:, i + 1, None], _log_sum(moves + (scores[:, i + 1] + hind[:, i + 1])[:, None, :], 2), ends)
    total = _log_sum(fore[:, t - 1] + ends, 1)
    each = np.where(real[:, :, None], np.exp(fore + hind - total[:, None, None]), 0.0)
    pairs = np.exp(fore[:, :-1, :, None] + moves + (scores + hind)[:, 1:, None, :] - total[:, None, None, None])
    moved = np.where(real[:, 1:, None, None], pairs, 0.0).sum(axis=(0, 1))
    moved[0] += each[:, 0].sum(axis=0)
    last = real.sum(axis=1) - 1
    moved[:, 0] += each[np.arange(n), last].sum(axis=0)
    return each, moved


def train(n: int = 6000, seed: int = 7, rounds: int = 14, rate: float = 0.3, shrink: float = 2e-4, batch: int = 64) -> Field:
    """Maximum likelihood by adaptive gradient steps over batches; the same result every time."""
    data = [_sequence(text, found) for text, found in examples(n, seed)]
    counted = Counter(f for rows, _ in data for row in rows for f in row)
    names = ["", *sorted(f for f, k in counted.items() if k >= 3)]
    at = {f: i for i, f in enumerate(names)}
    width = max(len(row) for rows, _ in data for row in rows)
    data.sort(key=lambda d: len(d[1]))
    batches = []
    for low in range(0, len(data), batch):
        part = data[low : low + batch]
        t = len(part[-1][1])
        ids, real, truth = np.zeros((len(part), t, width), np.int32), np.zeros((len(part), t), bool), np.zeros((len(part), t), np.int64)
        for i, (rows, labels) in enumerate(part):
            real[i, : len(labels)], truth[i, : len(labels)] = True, labels
            for j, row in enumerate(rows):
                known = [at[f] for f in row if f in at]
                ids[i, j, : len(known)] = known
        batches.append((ids, real, truth))
    weights, moves = np.zeros((len(names), 2)), np.zeros((3, 3))
    moves[0, 2] = -1e6
    seen, seen_moves = np.full((len(names), 2), 1e-4), np.full((3, 3), 1e-4)
    free = np.ones((3, 3), bool)
    free[0, 2] = free[0, 0] = False
    r = random.Random(seed)
    for _ in range(rounds):
        r.shuffle(batches)
        for ids, real, truth in batches:
            scores = np.zeros((*truth.shape, 3))
            scores[:, :, 1:] = weights[ids].sum(axis=2)
            scores[:, 0, 2] = -1e6
            each, moved = chances(scores, moves, real)
            off = np.zeros((*truth.shape, 2))
            for y in (1, 2):
                off[:, :, y - 1] = np.where(real, (truth == y) - each[:, :, y], 0.0)
            flat = ids.reshape(-1)
            g = np.stack([np.bincount(flat, weights=np.repeat(off[:, :, y].reshape(-1), width), minlength=len(names)) for y in (0, 1)], axis=1)
            g -= shrink * len(truth) * weights
            g[0] = 0
            seen += g * g
            weights += rate * g / np.sqrt(seen)
            came = np.zeros((3, 3))
            for row, own in zip(truth, real, strict=True):
                path = [0, *row[own].tolist(), 0]
                np.add.at(came, (path[:-1], path[1:]), 1)
            step = np.where(free, came - moved, 0.0)
            seen_moves += step * step
            moves += np.where(free, rate * step / np.sqrt(seen_moves), 0.0)
    return Field({f: [round(float(x), 3) for x in w] for f, w in zip(names[1:], weights[1:], strict=True) if np.abs(w).max() >= 0.0005}, [[round(float(x), 3) for x in row] for row in moves])


def save(field: Field) -> None:
    lines = ",\n".join(f"{json.dumps(f)}: {list(w)}" for f, w in sorted(field.weights.items()))
    (Path(__file__).parent / "secret_field.json").write_text(f'{{"moves": {field.moves.tolist()},\n"weights": {{\n{lines}\n}}}}\n')


# --- tables


def _parts(batch: pa.RecordBatch, column: int, chars: int = BLOCK_CHARS, most: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with their texts, which are bounded in sum, or single rows."""
    low, texts, held = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py()
        if texts and (held + len(text or "") > chars or len(texts) == most):
            yield batch.slice(low, len(texts)), texts
            low, texts, held = i, [], 0
        texts.append(text)
        held += len(text or "")
    if texts:
        yield batch.slice(low, len(texts)), texts


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_crf of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained()
        field.most = (TOKENS_HELD, CHARS_HELD)
        for batch in batches:
            for part, texts in _parts(batch, 1):
                rows = []
                for base, found in spans(texts, field):
                    n = Counter(k for _, k, _ in found)
                    rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(found), n[3]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redacted(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """The rows with their secrets masked, and the length of the text (if there is such a column) made to fit."""
    at = docs.columns.index(text)
    size_at = docs.columns.index(size) if size in docs.columns else None
    schema = T.StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained()
        field.most = (TOKENS_BESIDE, CHARS_BESIDE)
        for batch in batches:
            for part, old in _parts(batch, at):
                new = [redacted_text(t, found) if t else t for t, (_, found) in zip(old, spans(old, field), strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if size_at is not None:
                    sizes = [s if a == b else len(b) for s, a, b in zip(part.column(size_at).to_pylist(), old, new, strict=True)]
                    columns[size_at] = pa.array(sizes, part.schema.field(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        field.forget()

    return docs.mapInArrow(run, schema)


if __name__ == "__main__":
    save(train())
