r"""Personal data: rule spans first, then generated candidates that boosted trees accept.

The base kinds are email, ip, card and phone. Patterns are written with possessive repeats and
guarded starts, so that no text, however long its runs of digits or letters, makes them backtrack
more than a constant number of times per character. A pattern's spans come from the text split at its matches, all in
SQL functions on the executors' JVM.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_of
from quern.llm.trees import as_sql, boost, value

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The base rules. A failed start is not tried again inside the same run of characters (\G admits the place right after a match).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Kinds that only the method finds.
MORE = ("secret", "iban", "id", "ip6")
EVERY = KINDS + MORE
_NAMED = r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?"
#: Generators of further candidates: looser or tighter than the rules, free to overlap them, and meant to miss little; the trees reject.
LOOSE = {
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}++(?: ?+(?:\(at\)|\[at\]|\{{at\}}) ?+[A-Za-z0-9-]++ ?+(?:\.|\(dot\)|\[dot\]|\{{dot\}}|dot ) ?+| at [A-Za-z0-9-]++ ?+(?:\(dot\)|\[dot\]|dot ) ?+)[A-Za-z]{{2,12}}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\[\.\]|\(\.\)| ?\[dot\] ?)[0-9]{1,3}+(?:\[\.\]|\(\.\)| ?\[dot\] ?|\.)[0-9]{1,3}+(?:\[\.\]|\(\.\)| ?\[dot\] ?|\.)[0-9]{1,3}+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}|3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5})(?![0-9])",
    "phone": r"(?=[0-9(+])(?<![0-9A-Za-z.+/-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z]|[.-][0-9])",
    "secret": rf"(?<=[\s:=>\"'])(?<=(?i:{_NAMED})[\"']?\s?(?:[:=]|=>)\s?[\"']?)[^\s\"',;<>]{{6,200}}+"
    r"|(?<![A-Za-z0-9_-])(?:A[KS]IA[A-Z0-9]{16}|gh[a-z]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[a-z]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_.-]{8,}+)"
    r"|(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/_-]{32,512}+={0,2}+(?![A-Za-z0-9+/=_.-])"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?<=://)[^/\s:@]{1,64}+:[^/\s:@]{1,64}+(?=@)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
}
#: What a doc must contain for a pattern to be run at all.
_MARK = {
    ("email", 0): "contains(t, '@')",
    ("phone", 0): "contains(t, '+')",
    ("email", 1): "(contains(t, '(at)') or contains(t, '[at]') or contains(t, '{at}') or (contains(t, ' at ') and contains(t, 'dot')) or contains(t, '(AT)') or contains(t, '[AT]') or contains(t, '(At)') or contains(t, '[At]'))",
    ("ip", 1): "(contains(t, '[.]') or contains(t, '(.)') or contains(t, '[dot]'))",
    ("secret", 1): "(named or (has_digit and t rlike '[0-9][A-Za-z0-9+/_-]{8}|[A-Za-z+/_-]{8}[0-9]'))",
    ("iban", 1): "has_digit and t rlike '[A-Z][0-9]{2} ?[A-Z0-9]'",
    ("id", 1): "has_digit and t rlike '[0-9]-[0-9]{2}-[0-9]'",
    ("ip6", 1): "has_digit and contains(t, ':') and t rlike '[0-9A-Fa-f]:[0-9A-Fa-f:]{2}'",
}
#: What of the names of secrets is looked for before patterns are run, in the cases they are written in.
_PARTS = [form for part in ("assw", "assphr", "pwd", "ecret", "oken", "_key", "-key", "pikey", "esskey", "atekey", "redential", "://", "-----begin") for form in sorted({part, part.upper(), part.title()})]
BEFORE, AFTER = 24, 8
_HINTS = {
    "email": r"(?i)e-?mail|contact|write|reach",
    "ip": r"(?i)\bip\b|host|server|address|from",
    "card": r"(?i)card|visa|credit|debit|amex|payment",
    "phone": r"(?i)phone|tel\b|tel\.|call|fax|mobile|cell|contact",
    "secret": rf"(?i)(?:{_NAMED}|auth|bearer|://)[\"']?\s?(?:[:=]|=>)?\s?[\"']?$",
    "iban": r"(?i)iban|account|konto|bank",
    "id": r"(?i)\bssn\b|social|security|\bid\b|tax",
    "ip6": r"(?i)\bip\b|ipv6|host|server|address|from",
}
_AGAINST = r"(?i)order|invoice|isbn|version|serial|ref|sku|total|part no|[$#] ?$|doi|sha|md5|commit|hash|checksum|digest|etag|uuid"
_PREFIXED = r"^(?:A[KS]IA|gh[a-z]_|sk-|xox[a-z]-|eyJ|-----BEGIN)"
_DOMAIN = r"(?i)(?:com|org|net|edu|gov|info|[^a-z][a-z]{2})$"
_GLUED = r"[A-Za-z0-9_/]$"

#: Features as (name, SQL over d, the same in Python over a candidate).
FEATURES = [
    *[(f"f_{kind}", f"CAST(d.k = {k} AS INT)", lambda c, kind=kind: int(c["kind"] == kind)) for k, kind in enumerate(EVERY)],
    ("f_digits", "length(d.digits)", lambda c: len(c["digits"])),
    ("f_length", "length(d.m)", lambda c: len(c["m"])),
    ("f_upper", "length(regexp_replace(d.m, '[^A-Z]', ''))", lambda c: len(re.sub("[^A-Z]", "", c["m"]))),
    ("f_lower", "length(regexp_replace(d.m, '[^a-z]', ''))", lambda c: len(re.sub("[^a-z]", "", c["m"]))),
    ("f_plus", "CAST(startswith(d.m, '+') AS INT)", lambda c: int(c["m"].startswith("+"))),
    ("f_paren", "CAST(contains(d.m, '(') AS INT)", lambda c: int("(" in c["m"])),
    ("f_dots", "length(d.m) - length(replace(d.m, '.', ''))", lambda c: c["m"].count(".")),
    ("f_hex", "CAST(d.m rlike '^[0-9a-fA-F]+$' AS INT)", lambda c: int(bool(re.search("^[0-9a-fA-F]+$", c["m"])))),
    ("f_domain", None, lambda c: int(bool(re.search(_DOMAIN, c["m"])))),
    ("f_prefix", None, lambda c: int(bool(re.search(_PREFIXED, c["m"])))),
    ("f_luhn", None, lambda c: luhn(c["digits"])),
    ("f_octets", None, lambda c: octets(c["m"])),
    ("f_mod97", None, lambda c: mod97(c["m"])),
    ("f_hint", None, lambda c: int(bool(re.search(_HINTS[c["kind"]], c["ctx"])))),
    ("f_against", None, lambda c: int(bool(re.search(_AGAINST, c["ctx"])))),
    ("f_glued", None, lambda c: int(bool(re.search(r"^[A-Za-z0-9_]", c["nxt"]) or re.search(_GLUED, c["ctx"])))),
]


def mod97(text: str) -> int:
    """Whether the letters and digits of a bank account number have the remainder 1."""
    bare = re.sub("[^0-9A-Z]", "", text)
    rest = 0
    for c in bare[4:] + bare[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return int(len(bare) > 4 and rest == 1)


def luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return int(bool(digits) and total % 10 == 0)


def octets(text: str) -> int:
    parts = [p for p in re.split(r"[^0-9]+", text) if p]
    return int(len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts))


def _luhn_sql(digits: str) -> str:
    d = f"CAST(substring(reverse({digits}), i, 1) AS INT)"
    return f"(length({digits}) > 0 AND aggregate(sequence(1, greatest(length({digits}), 1)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN coalesce({d}, 0) ELSE 2 * coalesce({d}, 0) - CASE WHEN coalesce({d}, 0) > 4 THEN 9 ELSE 0 END END) % 10 = 0)"


def _octets_sql(text: str) -> str:
    parts = f"filter(split({text}, '[^0-9]+'), p -> p <> '')"
    return f"(size({parts}) = 4 AND forall({parts}, p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(concat('0', ltrim('0', p)), 4) AS INT), 999) <= 255))"


def _mod97_sql(text: str) -> str:
    bare = f"regexp_replace({text}, '[^0-9A-Z]', '')"
    turned = f"filter(split(concat(substring({bare}, 5), substring({bare}, 1, 4)), ''), c -> c <> '')"
    return f"(length({bare}) > 4 AND aggregate({turned}, 0, (a, c) -> (CASE WHEN c <= '9' THEN a * 10 + ascii(c) - 48 ELSE a * 100 + ascii(c) - 55 END) % 97) = 1)"


def _sample(rng: random.Random) -> tuple[dict, int]:
    """A made-up candidate with its context, and whether it is personal data."""
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    n = lambda k: pick("0123456789", k)
    word = lambda: pick("aeinorstlk", rng.randint(2, 8))
    kind, good = rng.choice([*EVERY, "secret"]), rng.random() < 0.5
    sep = rng.choice(" .-")
    hint = {
        "email": ["email ", "contact: ", "write to "], "ip": ["ip ", "host ", "server "], "card": ["card ", "visa ", "payment card "], "phone": ["tel. ", "call ", "phone: ", "mobile "],
        "secret": ["password: ", "token = ", 'token="', "secret=", 'api_key = "', "API-KEY: ", "access_key=", "pwd: ", "passwd='"], "iban": ["IBAN ", "account ", "bank: "], "id": ["SSN ", "ssn: ", "social security "], "ip6": ["ip ", "ipv6 ", "host "],
    }[kind]
    no = rng.choice(["order ", "invoice ", "ISBN ", "version ", "serial ", "ref ", "#", "$", "sku "])
    if kind == "email":
        m = f"{word()}{rng.choice(['(at)', ' [at] ', ' (at) ', ' at '])}{word()}{rng.choice(['.', ' (dot) ', '[dot]', ' dot '])}{rng.choice(['com', 'org', 'net', 'de', 'io', 'info']) if good else word() + word()}"
        if " at " in m and good and " dot " not in m:
            m = m.replace(".", " dot ")
    elif kind == "ip":
        m = "[.]".join(str(rng.randint(0, 255) if good else rng.randint(200, 999)) for _ in range(4))
    elif kind == "card":
        digits = n(15)
        last = next(d for d in "0123456789" if luhn(digits + d))
        last = last if good else str((int(last) + rng.randint(1, 9)) % 10)
        digits += last
        m = rng.choice(["", sep]).join(digits[k : k + 4] for k in (0, 4, 8, 12))
    elif kind == "secret":
        alphabet = rng.choice(["0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789", "abcdefghijkmnpqrstuvwxyz0123456789!%$&*", "0123456789ABCDEF"])
        m = pick(alphabet, rng.choice([8, 12, 16, 20, 24, 32, 40, 64]))
        if good and rng.random() < 0.25:
            m = rng.choice(["AKIA" + pick("ABCDEFGHIJKLMNOP234567", 16), "ghp_" + pick("abcdefghijXYZ0123456789", 36), "sk-" + pick("abcdefghijXYZ0123456789", 40), "eyJ" + pick("abcXYZ0123", 20) + "." + pick("abcXYZ0123", 30)])
            hint = [*hint[:3], f"{word()} ", f"{word()}: ", ""]
        elif not good:
            # Digests that are named as such or not at all, and ordinary words after the keyword.
            m = rng.choice([pick("0123456789abcdef", rng.choice([32, 40, 64])), pick("abcdefXYZ0123456789/", 48), pick("aeinorstlk", rng.randint(6, 10)), "/".join(word() for _ in range(9))])
            no = rng.choice(hint) if len(m) <= 10 and m.isalpha() else rng.choice(["sha256: ", "md5 ", "commit ", "checksum=", "hash ", "etag: ", f"{word()} ", f"{word()}: "])
    elif kind == "iban":
        bare = rng.choice(["DE", "GB", "FR", "ES", "IT"]) + "00" + n(18)
        value_ = (98 - int(str("".join(str(int(c, 36)) for c in bare[4:] + bare[:4]))) % 97) % 97
        check = f"{value_ if good else (value_ + rng.randint(1, 90)) % 97:02d}"
        bare = bare[:2] + check + bare[4:]
        m = bare if rng.random() < 0.5 else " ".join(bare[k : k + 4] for k in range(0, len(bare), 4))
        good = bool(mod97(m))
    elif kind == "id":
        m = f"{n(3)}-{n(2)}-{n(4)}"
    elif kind == "ip6":
        m = ":".join(pick("0123456789abcdef", 4) for _ in range(8)) if good else ":".join(n(2) for _ in range(rng.randint(3, 5)))
        m = m if not good or rng.random() < 0.5 else "2001:db8::" + pick("0123456789abcdef", 4)
    else:
        form = rng.random()
        area = f"({n(3)}) " if form < 0.3 else n(3) + sep
        m = (rng.choice(["", "", "+1 ", "+44 "]) if good else "") + area + n(3) + sep + n(4)
        if form > 0.6:
            m = rng.choice([f"0{n(2)} {n(4)} {n(4)}", f"0{n(3)} {n(3)} {n(3)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(4)}-{n(6)}"]) if good else rng.choice([f"{n(4)}-{n(2)}-{n(2)}", f"{n(3)}.{n(3)}.{n(2)}", f"{n(2)} {n(3)} {n(3)}", f"{n(5)} {n(4)}"])
    close = ("secret", "id") if rng.random() < 0.95 else ()
    if good:
        ctx = rng.choice(hint) if kind in close or rng.random() < 0.6 else f"{word()} "
    else:
        ctx = no if kind == "secret" or rng.random() < 0.7 else f"{word()} "
    if kind == "phone" and good and "+" not in m and "(" not in m:
        ctx = rng.choice(hint)
    nxt = rng.choice([" ", ". ", ", ", "\n", '"', "'"]) if good or rng.random() < 0.6 else word()
    c = {"kind": kind, "m": m, "ctx": (f"{word()} {word()} " + ctx)[-BEFORE:], "nxt": nxt[:AFTER]}
    if not good and kind in ("phone", "id") and not re.search(_AGAINST, c["ctx"]):
        c["ctx"] = c["ctx"][: -len(ctx)] + no if rng.random() < 0.5 else c["ctx"]
    c["digits"] = re.sub(r"[^0-9]", "", m)
    return c, int(good)


@lru_cache(maxsize=1)
def model(rows: int = 6000, seed: int = 5, precision: float = 0.98) -> tuple[tuple, tuple]:
    """Trees fitted to ``rows`` made-up candidates, and for each kind the least log odds that keeps ``precision`` on a third held out."""
    rng = random.Random(seed)
    made = [_sample(rng) for _ in range(rows)]
    x = np.array([[f(c) for _, _, f in FEATURES] for c, _ in made], dtype=np.float64)
    y = np.array([g for _, g in made], dtype=np.float64)
    cut = rows * 2 // 3
    trees = boost(x[:cut], y[:cut], trees=48, depth=3)
    z = np.array([sum(value(t, r) for t in trees) for r in x[cut:]])
    kinds = np.array([c["kind"] for c, _ in made[cut:]])
    limits = []
    for kind in EVERY:
        own, held = z[kinds == kind], y[cut:][kinds == kind]
        fit = [t for t in np.unique(own) if held[own >= t].mean() >= precision]
        limits.append(float(max(min(fit), 0.0)) if fit else float("inf"))
    return tuple(trees), tuple(limits)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(matches: str, parts: str) -> str:
    """SQL for the array of (s, e, m) of the matches; sums run in blocks of 256, so that long arrays are not copied for each entry."""
    one = f"struct(a.p + length({parts}[i]) + length({matches}[i]) AS p, concat(a.o, array(struct(a.p + length({parts}[i]) AS s, a.p + length({parts}[i]) + length({matches}[i]) AS e, {matches}[i] AS m))) AS o)"
    empty = "CAST(array() AS array<struct<s:int,e:int,m:string>>)"
    block = f"aggregate(sequence(256 * b, least(256 * b + 255, size({matches}) - 1)), struct(acc.p AS p, {empty} AS o), (a, i) -> {one})"
    outer = f"aggregate(sequence(0, (size({matches}) - 1) div 256), struct(0 AS p, CAST(array() AS array<array<struct<s:int,e:int,m:string>>>) AS o), (acc, b) -> transform(array({block}), x -> struct(x.p AS p, concat(acc.o, array(x.o)) AS o))[0])"
    return f"CASE WHEN size({matches}) > 0 THEN flatten({outer}.o) ELSE {empty} END"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_HOLDS = {
    "email": "true",
    "ip": _octets_sql("x.m"),
    "card": _luhn_sql(_DIGITS),
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text, and the text with them blacked out.

    Base spans of a kind are leftmost and do not overlap; a match that fails its check (parts of an
    ip at most 255; 14 to 19 digits that pass Luhn; 10 to 15 digits of a phone) is dropped for good.
    Loose generators then propose spans that may overlap each other, of the four kinds and of secret
    (keys, tokens, passwords after their names), iban, id and ip6; those clear of all base spans
    whose log odds under the trees reach the threshold calibrated for their kind are added, the
    earlier and then the likelier one where two overlap.

    One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (all, as kind:start:end in code points, end exclusive, by start, then kind in the order above),
    n_spans, redacted (the text with [kind] for each span). Null is the empty text; repeated rows are
    judged each; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    for level, patterns in enumerate((BASE, LOOSE)):
        found = {}
        for kind in patterns:
            p = _quoted(patterns[kind])
            mark = _MARK.get((kind, level), "has_digits" if kind != "email" else "true")
            found[f"m_{kind}{level}"] = F.expr(f"CASE WHEN {mark} THEN regexp_extract_all(t, {p}, 0) ELSE CAST(array() AS array<string>) END")
        if not level:
            named = " or ".join(f"contains(t, '{part}')" for part in _PARTS)
            rows = rows.withColumn("has_digit", F.expr("t rlike '[0-9]'"))
            rows = rows.withColumns({"has_digits": F.expr("has_digit and t rlike '[0-9][^A-Za-z]{6}'"), "named": F.expr(named)})
        rows = rows.withColumns(found)
        rows = rows.withColumns({f"p_{kind}{level}": F.expr(f"CASE WHEN size(m_{kind}{level}) > 0 THEN split(t, {_quoted(patterns[kind])}, -1) END") for kind in patterns})
        rows = rows.withColumns({f"s_{kind}{level}": F.expr(_places(f"m_{kind}{level}", f"p_{kind}{level}")) for kind in patterns})
    kept = {kind: f"transform(filter(s_{kind}0, x -> {_HOLDS[kind]}), x -> struct(x.s AS s, {k} AS k, x.e AS e))" for k, kind in enumerate(KINDS)}
    rows = rows.withColumns({f"b_{kind}": F.expr(sql) for kind, sql in kept.items()})
    rows = rows.withColumn("base", F.expr("array_sort(concat(b_email, b_ip, b_card, b_phone))"))
    loose = ", ".join(f"transform(s_{kind}1, x -> struct(x.s AS s, x.e AS e, x.m AS m, {k} AS k))" for k, kind in enumerate(EVERY))
    rows = rows.withColumn("cand", F.expr(f"filter(concat({loose}), c -> NOT exists(base, b -> b.s < c.e AND c.s < b.e))"))
    trees, limits = model()
    rows = rows.withColumn("added", F.expr(f"CASE WHEN size(cand) > 0 THEN {_chosen(trees, limits)} ELSE CAST(array() AS array<struct<s:int,k:int,e:int>>) END"))
    rows = rows.withColumn("every", F.expr("array_sort(concat(base, added))"))
    name = "element_at(array(" + ", ".join(f"'{kind}'" for kind in EVERY) + "), x.k + 1)"
    line = f"array_join(transform({{}}, x -> concat({name}, ':', x.s, ':', x.e)), ',')"
    clear = "filter(every, (x, i) -> i = 0 OR x.s >= array_max(transform(slice(every, 1, i), y -> y.e)))"
    pieces = f"array_join(transform(clear, (x, i) -> concat(substring(t, CASE WHEN i = 0 THEN 1 ELSE clear[i - 1].e + 1 END, x.s - CASE WHEN i = 0 THEN 0 ELSE clear[i - 1].e END), '[', {name}, ']')), '')"
    rows = rows.withColumn("clear", F.expr(clear))
    return rows.select(
        "doc_id",
        *[F.size(f"b_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.expr(line.format("base")), 256).alias("base_sha256"),
        F.expr(line.format("every")).alias("spans"),
        F.size("every").cast("long").alias("n_spans"),
        F.expr(f"CASE WHEN size(every) = 0 THEN t ELSE concat({pieces}, substring(t, element_at(clear, -1).e + 1)) END").alias("redacted"),
    )


def _chosen(trees: tuple, limits: tuple) -> str:
    """SQL for the accepted candidates of ``cand``: (s, k, e), none overlapping another."""
    ctx = f"substring(t, greatest(c.s - {BEFORE}, 0) + 1, least(c.s, {BEFORE}))"
    level1 = f"transform(cand, c -> named_struct('s', c.s, 'e', c.e, 'k', c.k, 'm', c.m, 'digits', regexp_replace(c.m, '[^0-9]', ''), 'ctx', {ctx}, 'nxt', substring(t, c.e + 1, {AFTER})))"
    flag = lambda sql: f"CAST({sql} AS INT)"
    rest = {
        "f_domain": flag(f"d.m rlike {_quoted(_DOMAIN)}"),
        "f_prefix": flag(f"d.m rlike {_quoted(_PREFIXED)}"),
        "f_luhn": flag(_luhn_sql("d.digits")),
        "f_octets": flag(_octets_sql("d.m")),
        "f_mod97": flag(_mod97_sql("d.m")),
        "f_hint": flag("CASE d.k " + " ".join(f"WHEN {k} THEN d.ctx rlike {_quoted(_HINTS[kind])}" for k, kind in enumerate(EVERY)) + " END"),
        "f_against": flag(f"d.ctx rlike {_quoted(_AGAINST)}"),
        "f_glued": flag(f"d.nxt rlike '^[A-Za-z0-9_]' OR d.ctx rlike {_quoted(_GLUED)}"),
    }
    level2 = f"transform({level1}, d -> named_struct('s', d.s, 'e', d.e, 'k', d.k, " + ", ".join(f"'{n}', {sql or rest[n]}" for n, sql, _ in FEATURES) + "))"
    score = " + ".join(as_sql(t, [f"f.{n}" for n, _, _ in FEATURES]) for t in trees)
    level3 = f"transform({level2}, f -> struct(f.s AS s, -({score}) AS z, f.k AS k, f.e AS e))"
    bound = "element_at(array(" + ", ".join("1e300D" if t == float("inf") else f"{t!r}D" for t in limits) + "), f.k + 1)"
    good = f"array_sort(filter({level3}, f -> -f.z >= {bound}))"
    empty = "CAST(array() AS array<struct<s:int,k:int,e:int>>)"
    return f"aggregate({good}, {empty}, (a, f) -> CASE WHEN size(a) = 0 OR f.s >= element_at(a, -1).e THEN concat(a, array(struct(f.s AS s, f.k AS k, f.e AS e))) ELSE a END)"
