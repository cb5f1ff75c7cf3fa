"""Personal data by anchor expansion.

One Aho-Corasick pass over the text in ASCII lower case finds the anchors: at-signs, plus signs,
``://`` after a scheme, and words that announce an identifier or a secret. A parser of its own for each anchor expands it to both sides and
validates what it found; digit runs, the anchors of network addresses and card numbers, are found
by one scan for digits. Every parser is linear in the characters it looks at.

Base kinds, leftmost and non-overlapping per kind, offsets in code points, end exclusive:

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four dot-separated digit runs, each at most 255
* card   digits with single spaces or hyphens between, 16 to 19 of them, passing Luhn
* phone  ``\\+[0-9][ ().0-9-]+[0-9]`` with 8 to 15 digits

Matches that fail a check are dropped and not tried again at a later start. The method adds:

* url      an address with a known scheme, up to white space, quotes or brackets, less closing marks
* account  what follows an identifier cue and holds 6 to 34 letters and digits, 6 digits at least;
  after the cue ``iban`` the checksum must hold
* secret   the value given to a name that ends in a secret's cue (``api_key = "..."``, ``token: ...``,
  ``Bearer ...``): in quotes 8 characters at least without white space, bare 12 at least that have a
  digit and a letter; and keys that are known by how they begin, with 16 characters after that

Defined cases: null and empty texts have no spans; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nodeloom.llm._common import append_columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account", "secret")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss")
SECRETS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "accesskey", "private key", "private_key", "private-key", "privatekey", "secret key", "auth_key", "authkey", "credential", "credentials", "bearer")
#: How keys of well-known issuers begin, in lower case.
PREFIXES = ("akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_", "sk-")
CUES = ("iban", "account no", "account number", "acct", "konto", "kontonummer", "ssn", "passport", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_DIGITS = re.compile(r"[0-9](?:[0-9 .-]*[0-9])?").finditer
_ADDRESS = re.compile(r"[0-9]++(?:\.[0-9]++)*+").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+").match
_GIVEN = re.compile(r"[\"'`]?[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}").match
_QUOTED = re.compile(r"([\"'`])([^\s\"'`]{8,512})\1").match
_BARE = re.compile(r"[\"'`]?([A-Za-z0-9+/_.~=-]{12,512})").match
_KEY = re.compile(r"[A-Za-z0-9_-]{16,255}").match
_UPPER = {c: c + 32 for c in range(65, 91)}
_ACCOUNT = re.compile(r"[ :#.=-]{0,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9])*+)").match


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.upper()
    return 15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(maxsize=1)
def automaton():
    """Finds (kind, anchor, its length) in texts in lower case."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("sign", ("@", "+", "://")), ("account", CUES), ("secret", SECRETS), ("prefix", PREFIXES)):
        for word in words:
            found.add_word(word, (kind, word, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text with A-Z in lower case, each character at its place."""
    low = text.lower()
    return low if text.isascii() else text.translate(_UPPER)


def _email(text: str, at: int, since: int) -> tuple[int, int] | None:
    start = at
    while start > since and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (end := _DOMAIN(text, at + 1)):
        return None
    return start, end.end()


def _url(text: str, at: int) -> tuple[int, int] | None:
    start = at
    while start and at - start < 6 and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    if text[start:at].lower() not in SCHEMES or not (end := _URL(text, at + 3)):
        return None
    stop = at + 3 + len(end[0].rstrip(".,;:!?)*"))
    return (start, stop) if stop > at + 3 else None


def _account(text: str, start: int, end: int, cue: str) -> tuple[int, int] | None:
    if start and text[start - 1].isalnum() or not (found := _ACCOUNT(text, end, end + 80)):
        return None
    if found.start(1) == end and cue != "iban":  # the cue is the start of a longer word
        return None
    words, kept = re.finditer(r"[A-Za-z0-9-]+", found[1]), []
    for word in words:  # parts without a digit end the identifier
        if not any(c.isdigit() for c in word[0]):
            break
        kept.append(word)
    for word in reversed(kept):  # what follows may be another identifier
        stop = found.start(1) + word.end()
        code = re.sub(r"[ -]", "", text[found.start(1) : stop])
        if 6 <= len(code) <= 34 and sum(c.isdigit() for c in code) >= 6 and (cue != "iban" or iban(code)):
            return found.start(1), stop
    return None


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _secret(text: str, end: int, cue: str) -> tuple[int, int] | None:
    given = _GIVEN(text, end)
    if given is None and cue == "bearer" and text[end : end + 1] == " ":
        at = end + 1
    elif given is None:
        return None
    else:
        at = given.end()
    if found := _QUOTED(text, at):
        return found.span(2)
    found = _BARE(text, at)
    if not found:
        return None
    value = found[1].rstrip(".")  # the end of a sentence
    return (found.start(1), found.start(1) + len(value)) if len(value) >= 12 and _mixed(value) else None


def _key(text: str, start: int, end: int) -> tuple[int, int] | None:
    if start and (text[start - 1].isalnum() or text[start - 1] in "_-") or not (found := _KEY(text, end)) or not _mixed(found[0]):
        return None
    return start, found.end()


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, in order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    free = dict.fromkeys(out, 0)  # where the last match of a kind ended, dropped or not

    def add(kind: str, found: tuple[int, int] | None, valid: bool = True) -> None:
        if found and found[0] >= free[kind]:
            free[kind] = found[1]
            if valid:
                out[kind].append(found)

    for last, (kind, sign, n) in automaton().iter(lowered(text)):
        at = last + 1 - n
        if sign == "@":
            add("email", _email(text, at, free["email"]))
        elif sign == "+":
            if at >= free["phone"] and (m := _PHONE(text, at)):
                add("phone", m.span(), 8 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif sign == "://":
            add("url", _url(text, at))
        elif kind == "account":
            add("account", _account(text, at, last + 1, sign))
        elif kind == "secret":
            add("secret", _secret(text, last + 1, sign))
        else:
            add("secret", _key(text, at, last + 1))
    for run in _DIGITS(text):
        if run.end() - run.start() < 7:
            continue
        if text.find(".", run.start(), run.end()) >= 0:
            for m in _ADDRESS(text, run.start(), run.end()):
                parts = m[0].split(".")
                at = m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                        out["ip"].append((at, end))
                    at = end + 1
        if run.end() - run.start() >= 16:
            for m in _CARD(text, run.start(), run.end()):
                if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    out["card"].append(m.span())
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def masked(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in capitals; overlapping spans become one, named after the first."""
    marks = sorted((a, b, k) for k, pairs in found.items() for a, b in pairs)
    parts, at = [], 0
    for a, b, kind in marks:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts of all kinds and of all spans, a digest of the base spans, and all spans, to every row."""

    def make():
        def columns(texts):
            found = [spans(t) for t in texts]
            digests = [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found]
            counts = [[len(f[k]) for f in found] for k in BASE + ADDED]
            return [*counts, [sum(map(len, f.values())) for f in found], digests, [joined(f, BASE + ADDED) for f in found]]

        return columns

    counts = [(f"n_{k}", T.LongType()) for k in (*BASE, *ADDED, "spans")]
    return append_columns(df, text_col, [*counts, ("base_sha256", T.StringType()), ("spans", T.StringType())], make)


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in its text replaced by placeholders; null texts become empty."""

    def make():
        return lambda texts: [[masked(t, spans(t)) for t in texts]]

    order = df.columns
    out = append_columns(df.withColumnRenamed(text_col, "__nodeloom_source"), "__nodeloom_source", [(text_col, T.StringType())], make, [c for c in order if c != text_col])
    return out.select(*order)
