"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans come from fixed patterns and always stand. The field adds spans that the patterns miss: e-mail addresses
written out, phone numbers without a country code, card numbers with other separators, account numbers (IBAN), social security
numbers, secrets such as keys and passwords. Text between the base spans is cut into islands: runs of words with a digit, an at sign or
a bracketed at or dot, joined by short written-out links, and what stands after `password:` and the like, spelled-out addresses
(`x at y dot z`) and heads of private keys. A span lies inside an island by definition, so that an exact search over islands is an exact
search over the text. In an island, every span of up to MAX_TOKENS tokens (a bracketed at or dot with its blanks is one) is a
candidate segment with features of the whole span (its shape, digit count, checksums, letters' mix, neighbours); dynamic programming chooses
boundaries and kinds together, in one pass over the island, whatever its length.

The field is trained once, on the driver, by gradient steps on its likelihood over N_TRAINING invented lines (fixed seed).
Null and empty texts have no spans. Texts of any length are taken whole. Equal rows give equal results, an empty table an empty one;
extra columns are ignored (and kept by `redact`). Of equally good segmentations the one met first stands.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_rows, spread

#: Kinds of base spans, in the order of ties; the field's own kinds follow.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn")
MAX_TOKENS = 24
N_TRAINING = 720
EPOCHS = 12
SEED = 7
#: Tokens of an island whose segments are held at once.
BLOCK_TOKENS = 1000

# --- base spans: fixed patterns -------------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is only entered at its start: a match from inside it would have started there
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base spans, by start and then kind as listed."""
    out = []
    end, at = 0, text.find("@")
    seen = 0
    while at >= 0:
        if at >= end:
            lo = max(end, seen)
            start = lo + len(text[lo:at].rstrip(LOCAL))
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((start, m.end(), "email"))
                end = m.end()
        seen = at + 1
        at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], BASE_KINDS.index(x[2])))


# --- islands and tokens ---------------------------------------------------------------------------------------------

ACTIVE = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
CHUNK = re.compile(r"\S+")
LINK = re.compile(r"(?:at|dot|\[at\]|\(at\)|\[dot\]|\(dot\))$", re.I)
MARKED = r"[\[({]\s*(?:at|dot)\s*[\])}]"
TOKEN = re.compile(rf"\s*{MARKED}\s*|-----|[A-Za-z0-9_]+|[^\sA-Za-z0-9_]|\s+", re.I)
MARKED_AT = re.compile(r"[\[({]\s*at\s*[\])}]", re.I)
WRITTEN = re.compile(r" at (?:.* )?[^ ]+ dot ", re.I)
SECRET_NAMES = r"(?:token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|client[_-]?secret)"
#: Islands beside the runs of words: (what must stand in the text, pattern).
MORE_ISLANDS = (
    (" dot ", re.compile(r"[a-z0-9._%+-]+ at [a-z0-9-]+(?: dot [a-z0-9-]+)+", re.I)),
    ("]", re.compile(rf"[a-z0-9._%+-]+\s*{MARKED}\s*[a-z0-9-]+(?:\s*(?:\.|{MARKED})\s*[a-z0-9-]+)*", re.I)),
    (")", re.compile(rf"[a-z0-9._%+-]+\s*\(\s*at\s*\)\s*[a-z0-9-]+(?:\s*(?:\.|{MARKED})\s*[a-z0-9-]+)*", re.I)),
    ("=", re.compile(rf"{SECRET_NAMES}[\"']? ?= ?[\"']?[^\s\"']+", re.I)),
    (":", re.compile(rf"{SECRET_NAMES}[\"']? ?: ?[\"']?[^\s\"']+", re.I)),
    ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
)
SECRET_WORD = re.compile(rf"(?:{SECRET_NAMES}|apikey|bearer|auth|\bkey)\W{{0,4}}$", re.I)
ASSIGNED = re.compile(rf"(?:{SECRET_NAMES}|apikey)[\"']?\s?[:=]\s?[\"']?$", re.I)
HASH_WORD = re.compile(r"(?:commit|revision|rev|blob|tree|parent|sha-?\d*|md5|hash|checksum|digest|etag|id)\W{0,4}$", re.I)
PHONE_WORD = re.compile(r"(?:tel|phone|call|mobile|fax|cell)\W{0,4}$", re.I)
CARD_WORD = re.compile(r"(?:card|visa|mastercard|amex)(?: number| no\.?)?\W{0,4}$", re.I)


def _runs(text: str):
    """(start, end) of runs of words that may hold spans."""
    run, last, linked = None, None, False  # last: where the previous word starts; linked: whether it ends in a link
    for m in CHUNK.finditer(text):
        if ACTIVE.search(m[0]) or (run and LINK.match(m[0])):
            if run and m.start() - run[1] <= 2:
                run[1] = m.end()
            else:
                if run:
                    yield tuple(run)
                # a written-out address starts one word before its first link
                marked = ACTIVE.search(m[0]) and not re.search("[0-9@]", m[0])
                run = [last if marked and last is not None else m.start(), m.end()]
        elif run and linked and m.start() - run[1] <= 2:
            run[1] = m.end()  # the word after a written-out at or dot
        elif run:
            yield tuple(run)
            run = None
        last = m.start()
        linked = run is not None and LINK.search(m[0]) is not None
    if run:
        yield tuple(run)


def islands(text: str, taken: list[tuple[int, int]]):
    """(start, end) of stretches that may hold spans, outside the taken ones."""
    found = list(_runs(text)) if ACTIVE.search(text) else []
    found += [m.span() for mark, pattern in MORE_ISLANDS if mark in text for m in pattern.finditer(text)]
    begins = [s for s, _ in taken]
    joined: list[list[int]] = []
    for s, e in sorted(found):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for s, e in joined:
        for a, b in taken[max(0, bisect.bisect_right(begins, s) - 1) :]:
            if a >= e:
                break
            if b > s:
                if a > s:
                    yield s, a
                s = b
        if s < e:
            yield s, e


# --- whole-span features --------------------------------------------------------------------------------------------

SHAPES = tuple(
    (name, re.compile(p, re.I))
    for name, p in (
        ("email", r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"),
        ("email_written", r"[a-z0-9._%+-]+\s*[\[({]\s*at\s*[\])}]\s*[a-z0-9-]+(?:(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*| dot )[a-z0-9-]+)+"),
        ("email_spaced", r"[a-z0-9._%+-]+ at [a-z0-9-]+(?: dot [a-z0-9-]+)+"),
        ("email_host", r"[a-z0-9._%+-]+@[a-z0-9-]+"),
        ("ipv4", r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"),
        ("phone_paren", r"\(\d{3}\) ?\d{3}[-. ]\d{4}"),
        ("phone_dashed", r"\d{3}[-.]\d{3}[-.]\d{4}"),
        ("phone_plus", r"\+\d[ ().\d-]{8,18}\d"),
        ("ssn", r"\d{3}-\d{2}-\d{4}"),
        ("iban", r"[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?"),
        ("known_key", r"(?:akia|asia)[a-z0-9]{16}|(?:gh[opsu]|sk|pk|xox[abp])[_-][a-z0-9_-]{16,}|ey[a-z0-9_-]{10,}\.[a-z0-9_-]+\.[a-z0-9_-]+"),
        ("key_head", r"-----begin [a-z ]*private key-----"),
        ("card_groups", r"\d{4}([ ./-])\d{4}\1\d{4}\1\d{2,7}"),
        ("digits_only", r"\d+"),
        ("hex", r"[0-9a-f]+"),
        ("alnum_mixed", r"(?=[a-z0-9_-]*\d)(?=[a-z0-9_-]*[a-z])[a-z0-9_-]+"),
        ("date", r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"),
        ("version", r"v?\d+(?:\.\d+){1,2}"),
    )
)
NAMES = [*(f"shape_{n}" for n, _ in SHAPES), "luhn", "luhn_fails", "iban_checks", "iban_fails", "digits_3", "digits_9", "digits_13", "digits_19", "digits_more", "chars_8", "chars_15", "chars_31", "chars_more",
         "high_entropy", "after_secret_word", "assigned", "after_hash_word", "near_digit", "after_phone_word", "after_card_word", "quoted", "touches_word", "touches_digit", "one_token", "edge_space", "has_at", "no_digit", "bias"]
FEATURE = {n: i for i, n in enumerate(NAMES)}


def iban_checks(span: str) -> bool:
    """Whether the number, its first four signs moved to the end and letters counted from 10, leaves 1 when divided by 97."""
    flat = span.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def span_features(text: str, s: int, e: int) -> list[int]:
    span = text[s:e]
    on = [f"shape_{n}" for n, p in SHAPES if p.fullmatch(span)]
    d = _digits(span)
    n = len(d)
    if 13 <= n <= 19 and n >= 0.7 * len(span):
        on.append("luhn" if luhn(d) else "luhn_fails")
    if "shape_iban" in on:
        on.append("iban_checks" if iban_checks(span) else "iban_fails")
    on.append("digits_3" if n <= 3 else "digits_9" if n <= 9 else "digits_13" if n <= 13 else "digits_19" if n <= 19 else "digits_more")
    size = e - s
    on.append("chars_8" if size <= 8 else "chars_15" if size <= 15 else "chars_31" if size <= 31 else "chars_more")
    if size >= 16 and span.isalnum():
        counts = {c: span.count(c) for c in set(span)}
        if -sum(k / size * math.log2(k / size) for k in counts.values()) > 3.2 and 0 < n < size:
            on.append("high_entropy")
    left = text[max(0, s - 24) : s]
    if SECRET_WORD.search(left):
        on.append("after_secret_word")
    if ASSIGNED.search(left):
        on.append("assigned")
    if HASH_WORD.search(left):
        on.append("after_hash_word")
    if PHONE_WORD.search(left):
        on.append("after_phone_word")
    if CARD_WORD.search(left):
        on.append("after_card_word")
    before, after = text[s - 1 : s], text[e : e + 1]
    if before and before in "\"'" and after == before:
        on.append("quoted")
    if (before.isalpha() and span[0].isalnum()) or (after.isalpha() and span[-1].isalnum()) or (before and before in "-._%+" and span[0].isalnum()) or after == "-":
        on.append("touches_word")
    if before.isdigit() or after.isdigit() or re.search(r"\d[-.]$", text[max(0, s - 2) : s]) or re.match(r"[-.]\d", text[e : e + 2]):
        on.append("touches_digit")
    elif re.search(r"\d $", text[max(0, s - 2) : s]) or re.match(r" \d", text[e : e + 2]):
        on.append("near_digit")
    if span[0].isspace() or span[-1].isspace():
        on.append("edge_space")
    if "@" in span:
        on.append("has_at")
    if not n:
        on.append("no_digit")
    on.append("bias")
    return [FEATURE[x] for x in on]


def tokens(text: str, s: int, e: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in TOKEN.finditer(text, s, e)]


def segments_from(text: str, bounds: list[tuple[int, int]], lo: int, hi: int):
    """Candidate segments (i, j) in tokens that start at tokens lo to hi - 1, by start, and each one's features.

    A segment starts and ends in a word (or a sign that opens or ends a number or a head) and has a digit, an at sign or a written-out one, or
    stands where a secret stands.
    """
    segments, features = [], []
    for i in range(lo, min(hi, len(bounds))):
        a = bounds[i][0]
        head = text.startswith("-----BEGIN", a)
        if not (text[a].isalnum() or text[a] in "+(" or head):
            continue
        assigned = ASSIGNED.search(text[max(0, a - 24) : a]) is not None
        for j in range(i + 1, min(len(bounds), i + MAX_TOKENS) + 1):
            last, b = bounds[j - 1]
            if not (text[b - 1].isalnum() or head and text[last:b] == "-----"):
                continue
            span = text[a:b]
            if "\n" in span:
                break
            if head or assigned or re.search("[0-9@]", span) or MARKED_AT.search(span) or WRITTEN.search(span):
                segments.append((i, j))
                features.append(span_features(text, a, b))
    return segments, features


def candidates(text: str, s: int, e: int):
    """Token bounds of text[s:e], all its candidate segments and their features."""
    bounds = tokens(text, s, e)
    return bounds, *segments_from(text, bounds, 0, len(bounds))


class SemiCRF:
    """Weights of features by kind, of kind pairs that follow each other, and of staying outside for a token (0)."""

    def __init__(self):
        self.w = np.zeros((len(NAMES), len(KINDS)))
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS)))  # from a kind, or from outside (last row)

    def scores(self, features) -> np.ndarray:
        return np.array([self.w[f].sum(axis=0) for f in features]) if features else np.zeros((0, len(KINDS)))

    def decode(self, n: int, segments, scores) -> list[tuple[int, int, int]]:
        """The best segmentation of n tokens: (i, j, kind)."""
        order = sorted(range(len(segments)), key=lambda x: segments[x][0])
        return self.decode_blocks(n, [([segments[x] for x in order], [scores[x] for x in order])])

    def decode_blocks(self, n: int, blocks) -> list[tuple[int, int, int]]:
        """The same in one forward pass over blocks of (segments, scores), by start; of past blocks only scores and origins by token are kept."""
        k = len(KINDS)
        best = np.full((n + 1, k + 1), -np.inf)
        best[0, k] = 0
        start, before = np.zeros((n + 1, k), np.int64), np.zeros((n + 1, k + 1), np.int8)
        done = 0  # staying outside is carried up to this token
        for segments, scores in blocks:
            for (i, j), score in zip(segments, scores):
                done = self._outside(best, before, done, i)
                reach = best[i][:, None] + self.follow
                prior = reach.argmax(axis=0)
                total = reach[prior, range(k)] + score
                for y in range(k):
                    if total[y] > best[j, y]:
                        best[j, y], start[j, y], before[j, y] = total[y], i, prior[y]
        self._outside(best, before, done, n)
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i = int(start[j, y]) if y < k else j - 1
            if y < k:
                out.append((i, j, y))
            j, y = i, int(before[j, y])
        return out[::-1]

    def _outside(self, best, before, done: int, upto: int) -> int:
        while done < upto:
            y = int(best[done].argmax())
            done += 1
            best[done, -1], before[done, -1] = best[done - 1, y], y
        return done

    def expectations(self, n: int, segments, scores):
        """Log of the sum over all segmentations, the chance of each (segment, kind), and expected followings."""
        k = len(KINDS)
        lse = lambda a, axis=None: np.logaddexp.reduce(a, axis=axis)
        fwd = np.full((n + 1, k + 1), -np.inf)
        fwd[0, k] = 0
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for x, (i, j) in enumerate(segments):
            by_end.setdefault(j, []).append(x)
            by_start.setdefault(i, []).append(x)
        for j in range(1, n + 1):
            fwd[j, k] = lse(fwd[j - 1])
            for x in by_end.get(j, ()):
                fwd[j, :k] = np.logaddexp(fwd[j, :k], lse(fwd[segments[x][0]][:, None] + self.follow, 0) + scores[x])
        bwd = np.full((n + 1, k + 1), -np.inf)
        bwd[n] = 0
        for i in range(n - 1, -1, -1):
            bwd[i] = bwd[i + 1, k]
            for x in by_start.get(i, ()):
                bwd[i] = np.logaddexp(bwd[i], lse(self.follow + scores[x] + bwd[segments[x][1], :k], 1))
        z = lse(fwd[n])
        follow = np.zeros_like(self.follow)
        chance = np.zeros((len(segments), k))
        for x, (i, j) in enumerate(segments):
            p = np.exp(fwd[i][:, None] + self.follow + scores[x] + bwd[j, :k] - z)
            follow += p
            chance[x] = p.sum(axis=0)
        return z, chance, follow

    def fit(self, examples, epochs: int = EPOCHS, rate: float = 0.4, decay: float = 1e-3) -> SemiCRF:
        """Gradient ascent (AdaGrad steps) on the log-likelihood. examples: (text, [(start, end, kind)])."""
        ready = []
        for text, gold in examples:
            bounds, segments, features = candidates(text, 0, len(text))
            at = {(bounds[i][0], bounds[j - 1][1]): x for x, (i, j) in enumerate(segments)}
            marked = [(at[s, e], KINDS.index(y), bounds, segments) for s, e, y in gold if (s, e) in at]
            ready.append((len(bounds), segments, features, marked))
        gw, gf = np.full_like(self.w, 1e-6), np.full_like(self.follow, 1e-6)
        for _ in range(epochs):
            for n, segments, features, marked in ready:
                if not segments:
                    continue
                _, chance, follow = self.expectations(n, segments, self.scores(features))
                target = np.zeros_like(chance)
                dfollow, before, last = -follow, len(KINDS), 0
                for x, y, _, _ in sorted(marked):
                    target[x, y] = 1
                    dfollow[before if segments[x][0] == last and before < len(KINDS) else len(KINDS), y] += 1
                    before, last = y, segments[x][1]
                dw = -decay * self.w
                for x, f in enumerate(features):
                    dw[f] += target[x] - chance[x]
                gw += dw**2
                gf += dfollow**2
                self.w += rate * dw / np.sqrt(gw)
                self.follow += rate * dfollow / np.sqrt(gf)
        return self


# --- invented training lines ------------------------------------------------------------------------------------------


def _with_luhn(r: random.Random, n: int) -> str:
    d = "".join(r.choices("0123456789", k=n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def training_lines(n: int = N_TRAINING, seed: int = SEED):
    """Invented lines with their spans: some of each kind in changing surroundings, and numbers that are nobody's."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 8)))
    num = lambda n: "".join(r.choices("0123456789", k=n))
    host = lambda: r.choice([word(), word() + num(1)])
    tld = lambda: r.choice(["com", "org", "net", "de", "io"])
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(r.choices("ABCDEFGHKLMNPQRSTabcdefghkmnpqrst23456789", k=n))
    noise = lambda: r.choice(["", "", "", " ", "###", "&&&", ".", ",", "!", "%%%"])

    letters = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))
    at = lambda: r.choice([" [at] ", "[at]", " (at) ", "(at)", " {at} ", " [ at ] "])
    dot = lambda: r.choice([" [dot] ", "[dot]", " (dot) ", "(dot)", "."])

    def iban() -> str:
        land, rest = r.choice(["DE", "GB", "FR", "ES"]), num(r.choice([18, 20, 16]))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        flat = f"{land}{check:02d}{rest}"
        return flat if r.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    def positive():
        kind = r.choice(["email", "email", "phone", "phone", "card", "secret", "secret", "secret", "iban", "ssn"])
        name = r.choice([word(), f"{word()}.{num(2)}", f"{word()}_{word()}", f"{word()}.{word()}"])
        if kind == "email":
            if r.random() < 0.25:
                return "", f"{word()} at {host()} dot {tld()}", "", kind
            d = dot()
            return "", f"{name}{at()}{host()}{d if r.random() < 0.7 else d + word() + d}{tld()}", "", kind
        if kind == "phone":
            span = r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])
            return r.choice(["", "", "tel ", "phone: ", "call ", num(2) + " "]), span, "", kind
        if kind == "card":
            d, sep = _with_luhn(r, 16), r.choice("./")
            return r.choice(["", "card ", "Visa: "]), sep.join(d[i : i + 4] for i in range(0, 16, 4)), "", kind
        if kind == "iban":
            return r.choice(["", "", "IBAN ", "iban: "]), iban(), "", kind
        if kind == "ssn":
            return r.choice(["", "ssn ", "SSN: "]), f"{num(3)}-{num(2)}-{num(4)}", "", kind
        q = r.choice(['"', "'", ""])
        shape = r.random()
        if shape < 0.15:
            return r.choice(["", f"key {q}", f"id={q}"]), r.choice(["AKIA", "ASIA"]) + letters(8) + num(3) + letters(5), q, kind
        if shape < 0.2:
            return "", f"-----BEGIN {r.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----", "", kind
        if shape < 0.3:
            return r.choice(["", "key: ", f"token={q}"]), r.choice(["ghp_", "sk-", "xoxb-"]) + mixed(28) + num(2), q, kind
        if shape < 0.5:
            return f"{r.choice(['password', 'passwd', 'pwd', 'Password', 'secret'])}{r.choice([': ', '=', ' = '])}{q}", r.choice([word() + num(1) + word(), word() + num(2), word() + word() + "x"]), q, kind
        key = r.choice(["token", "secret", "password", "api_key", "key", "access_key", "auth"])
        span = r.choice([hexes(40), hexes(32), hexes(64), mixed(24), mixed(32), mixed(40)])
        if not re.search("[0-9]", span):
            span += "7"
        return f"{key}{r.choice([' = ', '=', ': '])}{q}", span, q, kind

    def negative():
        return r.choice([
            lambda: num(r.randint(1, 6)), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(1)},{num(3)}.{num(2)}",
            lambda: num(r.randint(10, 16)), lambda: f"{num(3)}-{num(4)}", lambda: f"{word()}{num(2)}", lambda: f"{num(2)} {num(3)} {num(2)}", lambda: f"@{word()}", lambda: f"{num(4)} {num(4)}",
            lambda: f"page {num(2)} of {num(3)}", lambda: f"{num(1)}.{num(1)}", lambda: f"{num(5)}-{num(4)}", lambda: f"10 at {num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}9",
            lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}1"[:r.randint(12, 20)], lambda: f"{word()}-{num(3)}-{word()}", lambda: hexes(8), lambda: hexes(7),
            lambda: f"{r.choice(['commit', 'sha1', 'rev', 'tree', 'commit:'])} {hexes(40)}", lambda: f"{r.choice(['md5', 'checksum', 'digest:'])} {hexes(32)}", lambda: f"sha256: {hexes(64)}", lambda: hexes(40),
            lambda: f"{r.choice(['password', 'token', 'secret', 'key'])} {num(r.randint(1, 3))}", lambda: f"{word()} at {word()}{num(1)}", lambda: f"{letters(2)}{num(2)} {num(4)} {num(3)}", lambda: f"{letters(4)}{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(2)}", lambda: letters(20) + num(1),
        ])()

    out = []
    for i in range(n):
        lead = r.choice(["", word() + " ", word() + ", "])
        if i % 2:
            pre, span, post, kind = positive()
            text = lead + pre
            gold = [(len(text), len(text) + len(span), kind)]
            text += span + post + noise() + r.choice(["", " " + word(), " " + negative()])
        else:
            text, gold = lead + negative() + noise() + r.choice(["", " " + word(), " " + negative()]), []
        out.append((text, gold))
    return out


@functools.cache
def trained() -> SemiCRF:
    return SemiCRF().fit(training_lines())


# --- spans of a text ------------------------------------------------------------------------------------------------


def added_spans(text: str, base: list[tuple[int, int, str]], crf: SemiCRF) -> list[tuple[int, int, str]]:
    taken: list[list[int]] = []
    for s, e, _ in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out = []
    for s, e in islands(text, [(a, b) for a, b in taken]):
        bounds = tokens(text, s, e)
        blocks = (segments_from(text, bounds, at, at + BLOCK_TOKENS) for at in range(0, len(bounds), BLOCK_TOKENS))
        for i, j, y in crf.decode_blocks(len(bounds), ((segments, crf.scores(features)) for segments, features in blocks)):
            out.append((bounds[i][0], bounds[j - 1][1], KINDS[y]))
    return out


def find(text: str | None, crf: SemiCRF):
    """Base spans and all spans, each by start and then kind."""
    text = text or ""
    base = base_spans(text)
    every = sorted([*base, *added_spans(text, base, crf)], key=lambda x: (x[0], KINDS.index(x[2])))
    return base, every


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, crf: SemiCRF | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, numbers of base spans by kind, of the field's own kinds and of all spans, base and all spans of every whole text (start, end, kind in code points)."""
    crf = crf or trained()

    def make():
        as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]

        def f(key, text):
            base, every = find(text, crf)
            added = [sum(k == kind for *_, k in every) for kind in KINDS[len(BASE_KINDS) :]]
            return [(key, *(sum(k == kind for *_, k in base) for kind in BASE_KINDS), *added, len(every), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), as_rows(every))]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in (*KINDS, "spans"))
    return map_rows(spread(docs.select(F.col(id_col), F.col(text_col))), make, f"{id_col} {kind}, {counts}, base_sha256 string, spans string, found array<struct<start:int,end:int,kind:string>>")


def redact_text(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind in brackets."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, crf: SemiCRF | None = None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with the spans in the text replaced; a null text stays null."""
    crf = crf or trained()
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def make():
        def f(*row):
            row = list(row)
            if row[at] is not None:
                row[at] = redact_text(row[at], find(row[at], crf)[1])
                if chars is not None:
                    row[chars] = len(row[at])
            return [tuple(row)]

        return f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(spread(docs), make, schema)
