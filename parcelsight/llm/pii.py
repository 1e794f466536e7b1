"""Personal data by weak supervision.

Patterns propose spans. Labelers vote on each proposal: its shape (regular expressions and check digits),
word lists (gazetteers) and the words before it (context). Expectation-maximisation over the votes of the
whole corpus estimates how reliable each labeler is and how likely each proposal is true; a span classifier
is then fitted on these likelihoods, with the votes and with traits of the span that no labeler looks at
(length, neighbours), and decides on the proposals. The base spans, which hold by definition, stay whatever
it says.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelsight.llm.classify import apply_logistic, fit_logistic
from parcelsight.llm.common import stage

#: Kinds in the order of the span list: the base ones, then what the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "id", "name", "street")
#: Characters before a span that the context labeler reads, steps of the estimation, decision limit.
CONTEXT, STEPS, LIMIT = 40, 60, 0.5
#: Labelers, and so the signs in front of the traits.
VOTES = 5
#: A labeler is better than a coin and never sure; some proposals of a kind are true and some are false.
TRUST, SHARE = (0.55, 0.97), (0.2, 0.8)
#: Characters of a secret from which the number of its digits says nothing.
LONG_SECRET = 128
#: Span lengths at which the classifier's length trait changes.
LENGTHS = (9, 16, 32)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

#: Proposals beyond the base: obfuscated addresses, local phone numbers, keys and passwords.
_AT = re.compile(r"(?: ?[(\[]at[)\]] ?| at )", re.I)
_DOT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[A-Za-z0-9-]++)+", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_ASSIGNED = re.compile(r"(?<=[=:])[ \"']{0,2}([^\s\"'=]{8,}+)")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32,}+)(?![A-Za-z0-9])")
_TOLD = re.compile(r"\b(?:password|passwd|passcode|passphrase|pwd|token|secret)(?: is| was|'s) [\"']?([^\s\"']{6,}+)", re.I)

#: Account numbers, national ids, names and street addresses; letters run possessively or up to a bound.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?<![0-9.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LETTERED = re.compile(r"(?<![A-Za-z0-9-])[0-9]{8}-?[A-Z](?![A-Za-z0-9-])")
_NAME = re.compile(r"(?<![\w.'-])(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\b\.? )?"
                   r"[A-Z][a-zà-ÿ]++(?:(?: [A-Z]\.)? (?:Mc|O')?[A-Z][a-zà-ÿ]++(?:-[A-Z][a-zà-ÿ]++)?)(?![\w'])")
_STREET = re.compile(r"(?<![\w.,-])[0-9]{1,5}[a-z]? (?:[A-Z][a-z]++ ){1,3}(?:Street|Avenue|Road|Lane|Boulevard|Drive|Court|Square|"
                     r"Terrace|St|Ave|Rd|Ln|Blvd)\b\.?"
                     r"|(?<!\w)[A-ZÄÖÜ][a-zäöüß]*(?:straße|strasse|gasse|allee|platz) [0-9]{1,4}[a-z]?(?!\w)")

#: Lengths of account numbers by country.
_IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28,
    EE=20, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IS=26, IT=27,
    JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15,
    PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VA=22, VG=24,
    XK=20)
#: Fixed value: the check letters of Spanish ids by remainder.
_ID_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Common given names, titles, and capitalised words that are no names.
_GIVEN = frozenset("""Adam Ahmed Alan Alexander Alice Ana Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian
Carlos Carmen Carol Charles Christian Christine Christopher Claire Claudia Daniel David Deborah Diana Donald Dorothy Edward
Elena Elizabeth Emily Emma Eric Eva Fatima Francisco Frank Gary George Hannah Hans Helen Henry Isabel Jack Jacob James Jane
Jason Jean Jennifer Jessica John Jonathan Jorge Jose Joseph Juan Julia Karen Karl Katherine Kevin Klaus Larry Laura Laurent
Linda Lisa Louis Lucas Luis Margaret Maria Marie Martin Mary Matthew Michael Michelle Miguel Mohammed Monika Nancy Nicole
Olivia Patricia Patrick Paul Pedro Peter Philippe Pierre Rachel Rebecca Richard Robert Ronald Ruth Samuel Sandra Sarah
Scott Sharon Sofia Sophie Stefan Stephen Steven Susan Teresa Thomas Timothy Ursula Victoria Walter William Wolfgang""".split())
_TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Sr", "Sra", "Mme")
_NO_NAMES = frozenset("""The This That These Those And But For With From Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December Street Avenue Road University
College School Company Bank Church Island River Lake Mountain City County State North South East West""".split())

#: Word lists of the labelers.
_HOSTS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "co")
_CUES = {
    "email": ("mail", "correo", "courriel", "contact", "kontakt", "write", "address", "adresse"),
    "ip": ("ip", "host", "server", "address", "adresse", "ping", "addr"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit", "payment", "iban"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "handy", "appel", "llam", "ruf"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "api", "auth", "credential"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "id": ("ssn", "social", "security", "national", "dni", "nif", "tax", "identity"),
    "name": ("name", "nombre", "nom", "signed", "regards", "dear", "patient", "customer", "sincerely"),
    "street": ("address", "adresse", "lives", "live", "living", "resident", "residing", "wohn", "ship", "home"),
}
_KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")
_AREA_WORDS = ("555", "800", "888", "877")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_holds(span: str) -> bool:
    """The check digits of account numbers: moved to the end, letters as 10 to 35, the rest by 97 is 1."""
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def id_holds(span: str) -> bool:
    """National ids: no unissued part of a social security number, or the check letter of a Spanish one."""
    if span[-1].isdigit():
        area, group, serial = span.split("-")
        return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"
    return _ID_LETTERS[int(span[:8]) % 23] == span[-1]


def _ibans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        want = _IBAN_LENGTHS.get(m[0][:2])
        # capitals behind the number may have been taken for its last groups
        cuts = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
        ends = [e for e in cuts if len(text[m.start():e].replace(" ", "")) == want]
        if ends and iban_holds(text[m.start():ends[0]]):
            yield "iban", m.start(), ends[0]


def _names(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _NAME.finditer(text):
        words = m[0].split(" ")
        if words[0] in _GIVEN or words[0].rstrip(".") in _TITLES or "name" in _words_before(text, m.start()):
            yield "name", m.start(), m.end()


def _words_before(text: str, start: int) -> list[str]:
    return re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT):start].lower())[-4:]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what holds by definition, by kind and start."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            last = domain.end()
        # a run of local characters belongs to one sign, so that nothing is walked over twice
        at = text.find("@", max(at + 1, last))
    if not _DIGITS.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            parts = m[0].split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that the classifier decides on; none overlaps a base span or another of them.

    A number that fails its own check digits is no proposal.
    """
    more, low = [], None
    for bracket in ("(at)", "[at]", " at "):
        if bracket in text or bracket.strip() == bracket and bracket.upper() in text:
            low = True
    if low:
        for m in _AT.finditer(text):
            before = m.start()  # no run of local characters reaches over a match, so none is walked over twice
            while before and text[before - 1] in _LOCAL:
                before -= 1
            behind = _DOT_DOMAIN.match(text, m.end())
            if before < m.start() and behind and not (m[0] == " at " and " dot " not in behind[0].lower()):
                more.append(("email", before, behind.end()))
    if _DIGITS.search(text):
        more += [("phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        more += [("id", m.start(), m.end()) for one in (_SOCIAL, _LETTERED) for m in one.finditer(text) if id_holds(m[0])]
        more += [*_ibans(text), *(("street", m.start(), m.end()) for m in _STREET.finditer(text))]
        for m in _TOLD.finditer(text):
            told = m[1].rstrip(".,;:!?)")
            if len(told) >= 6 and _DIGITS.search(told):
                more.append(("secret", m.start(1), m.start(1) + len(told)))
    more += [("secret", m.start(), m.end()) for m in _KEY.finditer(text)]
    more += _names(text)
    taken = sorted((s, e) for _, s, e in base)
    out: list[tuple[str, int, int]] = []
    starts = [s for s, _ in taken]
    ends_before = np.maximum.accumulate([e for _, e in taken]) if taken else []
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            start, end = m.span(1)
            k = bisect_left(starts, start)
            if k < len(starts) and starts[k] < end:
                end = starts[k]  # what comes before a base span
            if end - start >= 8:
                more.append(("secret", start, end))
    last = -1
    for kind, start, end in sorted(more, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        k = bisect_left(starts, end)
        if start >= last and not (k and ends_before[k - 1] > start):
            out.append((kind, start, end))
            last = end
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the labelers say of a span: 1 yes, 0 no, 2 nothing. Shape, word list, context, digits, mix."""
    span = text[start:end]
    before = _words_before(text, start)
    cues = [k for k, words in _CUES.items() if any(w.startswith(words) for w in before)]
    context = 2 if not cues else int(kind in cues)
    digits = sum(c.isdigit() for c in span)
    if kind == "email":
        shape = int("." in span or "dot" in span.lower())
        listed = int(re.split(r"[.\s()\[\]]+", span.strip(".")) [-1].lower() in _HOSTS)
        count, mixed = 2, int(any(c.isalpha() for c in span.split("@")[0]))
    elif kind == "ip":
        parts = span.split(".")
        shape = int(not any(len(p) > 1 and p[0] == "0" for p in parts))
        listed = 0 if parts[0] in ("0", "255") else 2
        count, mixed = int(digits >= 6), 2
    elif kind == "card":
        plain = re.sub("[ -]", "", span)
        shape, listed = int(luhn(plain)), int(plain[0] in "3456")
        count, mixed = int(len(plain) in (15, 16)), int(len(set(plain)) > 3)
    elif kind == "phone":
        shape = int(span[0] in "+(")
        listed = int(any(w in span for w in _AREA_WORDS)) or 2
        count, mixed = int(9 <= digits <= 13), int(len(set(filter(str.isdigit, span))) > 2)
    elif kind == "iban":
        shape, listed = int(iban_holds(span)), int(len(span.replace(" ", "")) == _IBAN_LENGTHS[span[:2]])
        count, mixed = int(digits >= 10), int(len(set(span)) >= 5)
    elif kind == "id":
        shape, listed = int(id_holds(span)), 2
        count, mixed = 2, int(len(set(filter(str.isdigit, span))) > 2)
    elif kind == "name":
        words = span.split(" ")
        titled = words[0].rstrip(".") in _TITLES
        shape, listed = int(2 <= len(words) <= 4), int(words[int(titled)] in _GIVEN)
        count, mixed = int(titled) or 2, int(not _NO_NAMES.intersection(words))
    elif kind == "street":
        shape = int(not span.startswith("0"))
        listed = int(bool(re.search(r"(?:Street|Avenue|Road|Lane|Boulevard|Drive|stra(?:ß|ss)e)", span))) or 2
        count, mixed = int(bool(re.match(r",? (?:[0-9]{5}|[A-Z][a-z])", text[end:end + 8]))) or 2, 2
    else:
        shape = int(bool(_KEY.fullmatch(span)))
        listed = int(span.startswith(_KEY_HEADS)) or 2
        # the form of a key says all that its signs could
        count = 2 if shape or len(span) > LONG_SECRET else int(digits >= 2)
        mixed = 2 if shape else int(digits > 0 and any(c.isalpha() for c in span) and len(set(span)) >= 8)
    return shape, listed, context, count, mixed


def traits(text: str, start: int, end: int) -> str:
    """What the classifier sees of a span beyond the votes: its length and the characters next to it."""
    def beside(c: str) -> str:
        return "0" if not c or c.isspace() else "1" if c in "\"'()[]{}<>" else "2" if c in "=:,;.!?" else "3"
    return f"{sum(end - start >= n for n in LENGTHS)}{beside(text[start - 1:start])}{beside(text[end:end + 1])}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, base_text, more_text = [], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            show = lambda spans: [f"{k}:{s}:{e}" for k, s, e in spans]
            counts.append([sum(k == kind for k, _, _ in base) for kind in BASE_KINDS])
            shas.append(hashlib.sha256(",".join(show(base)).encode()).hexdigest())
            for spans, out in ((base, base_text), (proposals(text, base), more_text)):
                out.append([f"{k}:{s}:{e}:{''.join(map(str, votes(text, k, s, e)))}{traits(text, s, e)}"
                            for k, s, e in spans])
        n = np.array(counts, np.int64).reshape(-1, 4)
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(n[:, i]) for i in range(4)), pa.array(shas, pa.string()),
             pa.array(base_text, lists), pa.array(more_text, lists)],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "base", "more"])


def estimate(patterns: list[tuple[str, str, bool, int]]) -> dict[tuple[str, str, bool], float]:
    """How likely a span of (kind, votes) is true, from counts of (kind, votes with traits, is a base span).

    Traits say nothing here. A labeler has one reliability for each kind: how often it is right where it says yes or no;
    its silence says nothing. So what several labelers agree on is true, and two ways of being true (a key known by its
    form, a password by the word before it) are not taken for true and false. Reliabilities and likelihoods are
    estimated in turn, from a start that follows the majority of the votes.
    """
    out = {}
    for kind in KINDS:
        sums: dict[tuple[str, bool], int] = {}
        for k, v, base, n in patterns:
            if k == kind:
                sums[v[:VOTES], base] = sums.get((v[:VOTES], base), 0) + n
        if not sums:
            continue
        rows = [(v, base, n) for (v, base), n in sorted(sums.items())]
        marks = np.array([[int(c) for c in v] for v, _, _ in rows])
        weight = np.array([n for _, _, n in rows], float)
        base = np.array([b for _, b, _ in rows])
        likely = np.clip(((marks == 1).sum(1) + 1) / ((marks != 2).sum(1) + 2), 0.1, 0.9)
        yes, no = marks == 1, marks == 0
        for _ in range(STEPS):
            likely = np.where(base, 0.99, likely)[:, None]
            right = (weight[:, None] * (yes * likely + no * (1 - likely))).sum(0)
            trust = np.clip((right + 2) / ((weight[:, None] * (yes | no)).sum(0) + 3), *TRUST)
            free = weight * ~base
            share = np.clip(((free * likely[:, 0]).sum() + 1) / (free.sum() + 2), *SHARE)
            score = np.log(share / (1 - share)) + (yes * 1.0 - no) @ np.log(trust / (1 - trust))
            likely = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out |= {(kind, v, b): float(p) for (v, b, _), p in zip(rows, np.where(base, 0.99, likely), strict=True)}
    return out


def _features(kind: str, marks: str) -> list[float]:
    said, seen = marks[:VOTES], marks[VOTES:]
    one = [float(kind == k) for k in KINDS]
    says = [x for c in said for x in (float(c == "1"), float(c == "0"))]
    shows = [float(c == v) for c in seen for v in "123"]
    return [*one, *says, *shows, *(float(kind == k) * (said.count("1") - said.count("0")) for k in KINDS)]


def fit_spans(patterns: list[tuple[str, str, bool, int]]) -> tuple | None:
    """The span classifier: a logistic one on kind, votes and traits, fitted on the estimated likelihoods."""
    likely = estimate(patterns)
    if not likely:
        return None
    x, y, w = [], [], []
    for kind, marks, is_base, n in patterns:
        p = likely[kind, marks[:VOTES], is_base]
        x += [_features(kind, marks)] * 2
        y += [1.0, 0.0]
        w += [n * p, n * (1 - p)]
    return fit_logistic(np.array(x), np.array(y), np.array(w) + 1e-9)


def personal_data(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text).

    Returns one row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base
    spans) and spans: all of them, base ones and those that the classifier accepts, as kind:start:end in code
    points, joined by commas, by kind and start. A null or empty text has none. Rows are independent, also
    repeated ones; an empty table gives an empty result. What the estimation collects is the number of spans
    for each pattern of votes and traits, of which there are at most 9 kinds x 243 x 64, base or not; far fewer occur.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    scanned = stage(docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, {counts}, base_sha256 string, base array<string>, more array<string>"),
        "personal-spans")
    parts = F.split("x", ":")
    tally = (scanned.select(F.explode("base").alias("x"), F.lit(True).alias("is_base"))
             .unionByName(scanned.select(F.explode("more").alias("x"), F.lit(False).alias("is_base")))
             .groupBy(parts[0].alias("kind"), parts[3].alias("marks"), "is_base").agg(F.count("*").alias("n")))
    patterns = sorted((r["kind"], r["marks"], r["is_base"], r["n"]) for r in tally.collect())
    model = fit_spans(patterns)
    accepted = sorted({f"{k}:{m}" for k, m, is_base, _ in patterns if not is_base and model is not None
                       and apply_logistic(model, np.array([_features(k, m)]))[0] >= limit})
    def named(x):
        return F.concat_ws(":", F.split(x, ":")[0], F.split(x, ":")[3])
    kept = F.filter("more", lambda x: named(x).isin(accepted))
    order = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    spans = F.transform(F.concat("base", kept), lambda x: F.struct(
        order[F.split(x, ":")[0]].alias("k"), F.split(x, ":")[1].cast("long").alias("s"),
        F.concat_ws(":", F.slice(F.split(x, ":"), 1, 3)).alias("x")))
    return scanned.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256",
                          F.array_join(F.transform(F.sort_array(spans), lambda s: s["x"]), ",").alias("spans"))
