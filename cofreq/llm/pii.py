"""Operator 9: personal data by boosted candidate selection, in DataFrame
functions only.

*Base spans* are format matches with a validity test (e-mail, IP address, card
number with check digit, international phone number); they are always kept.
*Candidate generators* propose further, possibly overlapping spans with high
recall (spelled-out e-mail addresses, IPv6 addresses, cards with dots, national
phone formats).  A boosted-tree score over format and context features of each
candidate is compared with a threshold of its kind; accepted candidates that
overlap no base span are added.

Positions come from splitting: the pieces between matches (``split``) and the
matches themselves (``regexp_extract_all``) alternate, so running sums of their
lengths are the offsets, in code points.  Every array that a lambda refers to is
bound once (``let``), folds run in blocks, overlaps are found by one sort and two
folds, and redacted pieces are cut from chunks of the text, so a very long text
with many matches costs time in proportion to them.

The trees are fitted on labelled candidates in the generators' own forms, of
all kinds: base matches of a bounded sample are rewritten into them where they
stand (matches that pass the validity test are positive, others negative), and
fixed ones are added, so that every kind has both labels in any corpus
(negatives: order and part numbers, failed check digits, key fingerprints,
scores, prices, prose with 'at' and 'dot').  The validity test itself is no
feature.  A kind's threshold is the smallest score, but at least 0, at which
held-out precision is 0.99, or the log-odds of 0.99 where none is.  The trees
become one SQL expression.

Defined results: null text is empty; repeated rows are searched one by one;
other columns are ignored (``redact`` keeps them); an empty table gives base
spans alone."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import row_sample

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000  # documents whose candidates the trees are fitted on, at most about
SAMPLE_ROWS = 20_000  # candidates of the sample that are used
FORMS = 600  # training candidates of a kind and label from the sample, and as many fixed ones
BLOCK = 256
CHUNK = 4096  # characters

_LOCAL = "[A-Za-z0-9._%+-]"
# the contract's formats, written so that no long run is scanned twice
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?: ?(?i:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
             r"(?:(?: ?(?i:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]++)++"
             r"| (?i:at) [A-Za-z0-9-]++(?: (?i:dot) [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?=:*[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])(?:[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{2,4}|[0-9]{4}[._/][0-9]{6}[._/][0-9]{5}"
            r"|[0-9]{4}(?:[ -]{2,3}[0-9]{4}){2}[ -]{2,3}[0-9]{2,4})(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+.,:/-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
             r"|(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,8}(?:[ -][0-9]{2,4})?|[2-9][0-9]{9})(?![0-9A-Za-z])",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
MORE_NEEDS = {"email": r"(?i)(?:\(at\)|\[at\]| dot )", "ip": r"[0-9A-Fa-f]:|:[0-9A-Fa-f]", "card": r"[0-9]{4}[._/ -]{1,3}[0-9]{4}",
              "phone": r"[0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}\)?[ /-]?[0-9]{3}|[0-9]{10}"}
FEATURES = ("kind", "chars", "digits", "separators", "check_digit", "longest_group", "bracket", "spaced", "first_digits",
            "top_domain", "letter_before", "letter_after", "digit_near", "own_cue", "other_cue", "blank_before", "groups",
            "double_colon", "leading_zero", "bare")
_OWN = {
    "email": r"(?i)(?:mail|contact|write|reach|address|send|:\s*$)",
    "ip": r"(?i)(?:\bip|host|server|address|ping|node|client|peer|gateway|:\s*$)",
    "card": r"(?i)(?:card|visa|pay|account|master|amex|credit|debit|:\s*$)",
    "phone": r"(?i)(?:call|phone|\btel|mobile|fax|\bcell|dial|reach|contact|:\s*$)",
}
_OTHER = (r"(?i)(?:order|invoice|isbn|\bpart|serial|\bsku|\bref|\bcase|ticket|version|\bitem|model|\blot\b|batch|total"
          r"|guid|\bmac\b|\bkey|hash|fingerprint|score|ratio|look|stare|\baim|point|price|sold|bought|\broom|suite|flight"
          r"|\bgate|locker|\btime|clock|\bdate|\bid\b|\bno\.)")
_DOMAIN = r"(?i)(?:[.]|dot[)\]]? ?)(?:com|org|net|edu|gov|mil|int|info|biz|io|de|uk|fr|es|it|nl|pl|ru|jp|cn|br|eu|ch|at|ca|au|se)$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body
    (or a lambda in it) refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: int, step) -> Column:
    """For each element of an array of bigints, the fold of the elements before
    it (``step(fold, element)`` is associative), in blocks."""
    def scan(xs: Column, start: Column, fold) -> Column:
        return F.aggregate(
            xs, F.struct(F.array().cast("array<bigint>").alias("out"), start.alias("at")),
            lambda s, x: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), fold(s["at"], x).alias("at")), lambda s: s["out"])

    def blocked(v: Column) -> Column:
        n_blocks = F.floor((F.size(v) + F.lit(BLOCK - 1)) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(1), n_blocks), lambda b: F.slice(v, (b - 1) * BLOCK + 1, F.lit(BLOCK)))

    def scanned(blocks: Column) -> Column:
        starts = scan(blocks, F.lit(zero).cast("bigint"), lambda at, xs: F.aggregate(xs, at, step))
        return F.flatten(F.zip_with(blocks, starts, lambda xs, at: scan(xs, at, step)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocked(v), scanned)).otherwise(F.array().cast("array<bigint>")))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


_NONE = "array<struct<kind:int,start:bigint,end:bigint,hit:string,before:string,after:string>>"


def matches(text: Column, kind: int, pattern: str, needs: str) -> Column:
    """All matches of ``pattern`` as ``[kind, start, end, hit, before, after]``."""
    def placed(s: Column) -> Column:
        # gap and hit together advance from one start to the next
        first = running(F.zip_with(s["gaps"], s["hits"], lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("bigint")),
                        0, lambda at, x: at + x)
        return let(F.struct(s["hits"].alias("hits"), s["gaps"].alias("gaps"), first.alias("first")), made)

    def made(s: Column) -> Column:
        start = lambda i: F.get(s["first"], i) + F.length(F.get(s["gaps"], i))
        return F.transform(s["hits"], lambda h, i: F.struct(
            F.lit(kind).alias("kind"), start(i).cast("bigint").alias("start"), (start(i) + F.length(h)).cast("bigint").alias("end"),
            h.alias("hit"), F.right(F.get(s["gaps"], i), F.lit(24)).alias("before"),
            F.left(F.get(s["gaps"], i + 1), F.lit(4)).alias("after")))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                         F.split(text, pattern, -1).alias("gaps")), placed)
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(_NONE))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def valid(c: Column) -> Column:
    """The validity test of a base match."""
    ip = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}"
    n = F.length(digits(c["hit"]))
    return (F.when(c["kind"] == 0, F.lit(True))
            .when(c["kind"] == 1, c["hit"].rlike(ip))
            .when(c["kind"] == 2, n.between(14, 19) & _luhn(digits(c["hit"])))
            .otherwise(n.between(10, 15)))


def features(c: Column) -> list[Column]:
    """The features of a candidate, in the order of ``FEATURES``, as doubles."""
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    hit, number = c["hit"], digits(c["hit"])
    n = F.length(number)
    own = F.lit(False)
    for k, kind in enumerate(KINDS):
        own = own | ((c["kind"] == k) & c["before"].rlike(_OWN[kind]))
    return [
        c["kind"].cast("double"), F.length(hit).cast("double"), n.cast("double"),
        (F.length(hit) - F.length(F.regexp_replace(hit, "[ ().:@_/-]", ""))).cast("double"),
        flag((n > 0) & _luhn(F.when(n > 0, number).otherwise("1"))),
        F.array_max(F.transform(F.split(hit, "[^0-9A-Za-z]+"), F.length)).cast("double"),
        flag(hit.rlike(r"[(\[]")), flag(hit.rlike(" ")),
        # the digits that area codes, exchanges and card numbers begin with
        flag(F.when(c["kind"] == 2, hit.rlike("^[3-6]")).otherwise(number.rlike("^[2-9][0-9]{2}[2-9]"))),
        flag(hit.rlike(_DOMAIN)), flag(c["before"].rlike(r"\p{L}$")), flag(c["after"].rlike(r"^\p{L}")),
        flag(c["before"].rlike("[0-9.]$") | c["after"].rlike("^[0-9]")), flag(own), flag(c["before"].rlike(_OTHER)),
        flag((F.length(c["before"]) == 0) | c["before"].rlike(r"\s$")),
        F.size(F.split(F.regexp_replace(hit, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), "[^0-9A-Za-z]+")).cast("double"),
        flag(hit.contains("::")), flag(number.startswith("0")), flag(hit.rlike("^[0-9]+$"))]


class Trees:
    """Boosted depth-2 trees for log-odds; ``expression`` gives them as SQL."""

    def __init__(self, prior: float, trees: list, threshold: list[float]):
        self.prior, self.trees, self.threshold = prior, trees, threshold

    def expression(self, x: list[Column]) -> Column:
        out = F.lit(float(self.prior))
        for f, cut, low, high in self.trees:
            side = lambda s: F.when(x[s[0]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
            out = out + F.when(x[f] <= cut, side(low)).otherwise(side(high))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), float(self.prior))
        for f, cut, low, high in self.trees:
            side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
            out += np.where(x[:, f] <= cut, side(low), side(high))
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> Trees:
    """Logistic boosting; then, for each kind, the smallest threshold at which
    held-out precision is 0.99."""
    never = Trees(-9.0, [], [1e9] * len(KINDS))
    if len(y) < 20 or y.min() == y.max():
        return never
    held = np.arange(len(y)) % 4 == 3
    xt, yt = x[~held], y[~held]
    model = Trees(float(np.log(max(yt.mean(), 1e-3) / max(1 - yt.mean(), 1e-3))), [], [float(np.log(99))] * len(KINDS))
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0.05, 0.95, 12))) for f in range(x.shape[1])]

    def split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        g, h = grad[rows], hess[rows]
        best = (-1.0, 0, 0.0)
        for f, values in enumerate(cuts):
            for c in values:
                low = xt[rows, f] <= c
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, f, float(c))
        return best[1], best[2]

    def leaf(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        f, c = split(rows, grad, hess)
        low = xt[rows, f] <= c
        value = lambda r: float(rate * grad[r].sum() / (hess[r].sum() + 1))
        return f, c, value(rows[low]), value(rows[~low])

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.scores(xt)))
        grad, hess = yt - p, p * (1 - p)
        every = np.arange(len(yt))
        f, c = split(every, grad, hess)
        low = xt[:, f] <= c
        model.trees.append((f, c, leaf(every[low], grad, hess), leaf(every[~low], grad, hess)))
    s = model.scores(x[held])
    for k in range(len(KINDS)):
        mine = x[held][:, 0] == k
        for t in np.unique(s[mine]):
            if y[held][mine][s[mine] >= t].mean() >= 0.99:
                model.threshold[k] = max(float(t), 0.0)
                break
    return model


def _luhn_digit(number: str) -> str:
    """The digit that completes ``number`` to one with a right check digit."""
    doubled = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(number))]
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def _national(rng: random.Random, n: str) -> str:
    if n[0] == "0":
        return rng.choice(("{} {} {}", "{} {}{}", "({}) {} {}", "({}) {}{}", "{}/{}{}", "{}-{}{}")).format(n[:3], n[3:7], n[7:])
    return rng.choice(("({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {}-{}", "{} {} {}")).format(n[:3], n[3:6], n[6:10])


def _spelled(rng: random.Random, name: str, host: str) -> str:
    at, dot = rng.choice(((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."),
                          (" [at] ", "."), (" at ", " dot "), (" AT ", " DOT "), (" (AT) ", " (DOT) ")))
    return name + at + dot.join(host.split("."))


def _grouped(rng: random.Random, n: str) -> str:
    if len(n) == 15 and rng.random() < 0.5:
        return rng.choice("._/").join((n[:4], n[4:10], n[10:]))
    return rng.choice((".", "_", "/", "  ", " - ")).join(n[i:i + 4] for i in range(0, len(n), 4))


def _hex(rng: random.Random, sizes) -> str:
    return ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice(sizes))) for _ in range(8))


def _short_hex(rng: random.Random) -> str:
    """An IPv6 address with a run of zeros left out."""
    part = lambda k: ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((4, 4, 3, 2, 1)))) for _ in range(k))
    return rng.choice(("fe80", "2001:db8", "2a02:" + part(1), "fd" + part(1)[:2])) + "::" + part(rng.randint(1, 4))


def rewritten(rng: random.Random, kind: int, hit: str, good: bool) -> str | None:
    """A base match in a generator's form; None if it has none."""
    n = "".join(d for d in hit if "0" <= d <= "9")
    if kind == 0:
        return _spelled(rng, *hit.split("@", 1))
    if kind == 1:
        return _hex(rng, (4, 4, 4, 3, 1)) if good else _hex(rng, (2,))
    if kind == 2:
        return _grouped(rng, n) if 14 <= len(n) <= 16 else None
    return _national(rng, n[-10:]) if len(n) >= 10 else None


def fixed_forms(each: int = FORMS, seed: int = 9) -> list[tuple[int, str, str, str, bool]]:
    """``(kind, hit, before, after, label)``: labelled candidates of every form
    in varied contexts."""
    rng = random.Random(seed)
    number = lambda n, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    plain = ("", "and ", "to ", "is ", "the ", "from ", "or ", "see ", "(", "\n", "then ", "use ")
    cues = (("mail ", "contact: ", "write to ", "reach ", "e-mail: ", "send it to "),
            ("ip ", "host ", "server ", "address: ", "ping ", "client ", "node "),
            ("card ", "visa ", "pay with ", "account ", "credit card: ", "debit card "),
            ("call ", "phone: ", "tel. ", "mobile ", "fax ", "dial ", "contact us: "))
    others = ("order ", "order no. ", "invoice ", "isbn ", "part ", "serial no. ", "sku ", "ref. ", "case ", "ticket ",
              "version ", "item ", "model ", "lot ", "batch ", "total ", "room ", "suite ", "flight ", "gate ", "locker ", "id ")
    names = (("look ", "stare ", "aim ", "point ", "sold ", "bought ", "price ", *plain), ("guid ", "mac ", "key ", "hash ",
             "fingerprint ", "score ", "ratio ", "time ", "clock ", *plain), others + plain, others)
    afters = ("", " ", ". ", ", ", " now", " or ", ")", "\n")
    out = []
    for _ in range(each):
        for kind in range(4):
            before = rng.choice(("", "Please ", "we ", "so ")) + rng.choice(cues[kind] if rng.random() < 0.5 else plain)
            if kind == 0:
                hit = _spelled(rng, word(), word() + rng.choice((".com", ".org", ".net", ".edu", ".de", ".co.uk", ".io")))
            elif kind == 1:
                hit = _hex(rng, rng.choice(((4,), (4, 4, 3, 1), (1, 4), (1, 2, 3, 4))))
                while max(map(len, hit.split(":"))) < 3:
                    hit = _hex(rng, (4,))
                if rng.random() < 0.4:
                    hit = _short_hex(rng)
            elif kind == 2:
                body = number(rng.choice((13, 14, 15, 15, 15)), "3456")
                hit = _grouped(rng, body + _luhn_digit(body))
            else:
                hit = _national(rng, number(3, "23456789") + number(7, "23456789"))
                if "(" not in hit and " " in hit.replace("-", " ") and rng.random() < 0.5:
                    before = rng.choice(cues[3])
                shape = rng.random()
                if shape < 0.25:  # area codes that begin with 0
                    hit, before = _national(rng, "0" + number(rng.choice((9, 10)), "123456789")), rng.choice(cues[3] + ("on ", "under ", "at "))
                elif shape < 0.35:
                    hit, before = number(1, "23456789") + number(9), rng.choice(cues[3])
            out.append((kind, hit, before, rng.choice(afters), True))
            before = rng.choice(("", "The ", "my ", "so ")) + rng.choice(names[kind])
            if kind == 0:
                hit = rng.choice((f"{word()} (at) {rng.randint(1, 99)}.{number(2)}", f"{word()} [at] {word()}.{number(2)}",
                                  f"{word()} at {word()} dot {word()}s", f"look at {word()} dot", f"{word()} (at) {word()}.Then"))
                if hit.endswith(" dot"):
                    hit += " " + rng.choice(("on", "and", "that", "here", "which", "above"))
            elif kind == 1:
                times = ":".join(f"{rng.randint(0, 59):02d}" for _ in range(3))
                macs = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(2)) for _ in range(6))
                few = ":".join(number(rng.randint(1, 3)) for _ in range(rng.randint(3, 7)))
                hit = rng.choice((_hex(rng, (2,)), ":".join(number(rng.randint(1, 2)) for _ in range(8)), times, macs, few,
                                  rng.choice(("a", "1", "be", "12")) + "::"))
            elif kind == 2:
                hit = _grouped(rng, number(rng.choice((14, 15, 16, 16, 16))))
                body = "".join(d for d in hit if d.isdigit())
                if body[-1] == _luhn_digit(body[:-1]) and not before.endswith(others):  # a right check digit by chance
                    before = rng.choice(others)
            else:
                hit = rng.choice((_national(rng, number(10, "123456789")), _national(rng, number(10, "123456789")),
                                  "0" + number(rng.choice((2, 3))) + rng.choice(" /-") + number(rng.choice((3, 4, 6))), number(10, "23456789")))
                if hit.isdigit():
                    before = rng.choice(others + plain)
            out.append((kind, hit, before, rng.choice(afters), False))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on the rewritten candidates of a bounded sample of documents and on
    the fixed ones."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = docs.count()
    if not n:
        return boost(np.zeros((0, len(FEATURES))), np.zeros(0))
    sample = row_sample(rows, "id", n, SAMPLE_DOCS).where(F.col("text").rlike("[0-9@]"))
    found = sample.select(F.explode(F.concat(*(matches(F.col("text"), k, BASE[kind], NEEDS[kind])
                                               for k, kind in enumerate(KINDS)))).alias("c"))
    found = found.where(((F.col("c.kind") != 2) | (F.length(digits(F.col("c.hit"))) >= 12)) & (F.length("c.hit") <= 100))
    got = found.select("c.kind", "c.hit", "c.before", "c.after", valid(F.col("c")).alias("y"),
                       F.xxhash64("c.hit", "c.before").alias("o")).orderBy("o").limit(SAMPLE_ROWS).collect()
    rng, forms, used = random.Random(7), fixed_forms(), {}
    for r in got:
        form = rewritten(rng, r["kind"], r["hit"], r["y"])
        used[r["kind"], r["y"]] = used.get((r["kind"], r["y"]), 0) + (form is not None)
        if form is not None and used[r["kind"], r["y"]] <= FORMS:
            forms.append((r["kind"], form, r["before"], r["after"], r["y"]))
    rng.shuffle(forms)
    cases = docs.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(forms)],
                                              "i int, kind int, hit string, before string, after string, y boolean")
    c = {name: F.col(name) for name in ("kind", "hit", "before", "after")}
    made = sorted(cases.select("i", "y", F.array(*features(c)).alias("x")).collect(), key=lambda r: r["i"])
    return boost(np.array([r["x"] for r in made], float), np.array([float(r["y"]) for r in made]))


def find(text: Column, model: Trees) -> tuple[Column, Column]:
    """(base spans, accepted further spans) of a text: arrays of candidates."""
    text = F.coalesce(text, F.lit(""))
    base = F.filter(F.concat(*(matches(text, k, BASE[kind], NEEDS[kind]) for k, kind in enumerate(KINDS))), valid)
    more = F.concat(*(matches(text, k, MORE[kind], MORE_NEEDS[kind]) for k, kind in enumerate(KINDS)))
    threshold = lambda c: F.element_at(F.array(*(F.lit(float(t)) for t in model.threshold)), c["kind"] + 1)
    # the features are worked out once for each candidate
    scored = F.transform(more, lambda c: F.struct(c.alias("c"), F.array(*features(c)).alias("x")))
    taken = F.filter(scored, lambda s: model.expression([F.get(s["x"], i) for i in range(len(FEATURES))]) >= threshold(s["c"]))
    return base, F.transform(taken, lambda s: s["c"])


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"], c["kind"], c["end"])))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(
        ":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")


def detect(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``[doc_id, base, more]`` for every row: base spans and added spans."""
    base, more = find(F.col(text_col), model)
    rows = df.select(F.col(id_col).alias("doc_id"), base.alias("base"), more.alias("more"))
    return rows.select("doc_id", "base", apart(F.col("base"), F.col("more")).alias("more"))


def apart(base: Column, more: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``, by one sort and two
    running folds."""
    entry = lambda added: lambda c: F.struct(c["start"].alias("start"), F.lit(added).alias("added"), c["end"].alias("end"), c.alias("c"))
    ordered = F.array_sort(F.concat(F.transform(base, entry(1)), F.transform(more, entry(2))))
    far = 1 << 40

    def kept(all_spans: Column) -> Column:
        ended = running(F.transform(all_spans, lambda s: F.when(s["added"] == 1, s["end"]).otherwise(F.lit(0))), 0, larger)
        starts = F.transform(F.reverse(all_spans), lambda s: F.when(s["added"] == 1, s["start"]).otherwise(F.lit(far)).cast("bigint"))
        return let(F.struct(all_spans.alias("s"), ended.alias("e"), F.reverse(running(starts, far, smaller)).alias("b")), chosen)

    def chosen(t: Column) -> Column:
        free = F.filter(t["s"], lambda s, i: (s["added"] == 2) & (F.get(t["e"], i) <= s["start"]) & (F.get(t["b"], i) >= s["end"]))
        return F.transform(free, lambda s: s["c"])

    return let(ordered, kept)


def digest(spans: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and the list of all spans."""
    count = lambda k: F.size(F.filter(F.concat("base", "more"), lambda c: c["kind"] == k)).cast("bigint")
    return spans.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.concat("base", "more")).alias("spans"))


def merged(spans: Column) -> Column:
    """Overlapping ``[start, kind, end]`` (in order of start) as one, named
    after the first."""
    def heads(t: Column) -> Column:
        first = F.filter(F.transform(t["s"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(t["e"], i).alias("before"))),
                         lambda s: s["start"] >= s["before"])
        return let(F.struct(first.alias("h"), F.array_max(F.transform(t["s"], lambda s: s["end"])).alias("last")), ends)

    def ends(t: Column) -> Column:
        # what ended before the next head is the end of this one
        return F.transform(t["h"], lambda h, i: F.struct(
            h["start"].alias("start"), h["kind"].alias("kind"), F.coalesce(F.get(t["h"], i + 1)["before"], t["last"]).alias("end")))

    return let(spans, lambda s: let(F.struct(s.alias("s"), running(F.transform(s, lambda x: x["end"]), 0, larger).alias("e")), heads))


def _between(text: Column, places: Column) -> Column:
    """The pieces ``[start, end)`` of a text, cut from chunks of it, so that a
    piece costs its own length and no scan from the start of the text."""
    n = F.floor(F.length(text) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))

    def piece(chunk: Column, p: Column) -> Column:
        first = F.floor(p["start"] / CHUNK).cast("int")
        some = F.array_join(F.slice(chunk, first + 1, F.floor(p["end"] / CHUNK).cast("int") - first + 1), "")
        return F.substring(some, (p["start"] - first * CHUNK + 1).cast("int"), (p["end"] - p["start"]).cast("int"))

    return let(chunks, lambda chunk: F.transform(places, lambda p: piece(chunk, p)))


def redact(df: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets; overlapping
    spans become one, named after the first."""
    base, more = find(F.col(text_col), model)
    spans = F.array_sort(F.transform(F.concat(base, more), lambda c: F.struct(c["start"], c["kind"], c["end"])))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, found = F.col(text_col), F.col("__cofreq_spans")
    left = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(found, lambda c: c["end"]))
    right = F.concat(F.transform(found, lambda c: c["start"]), F.array(F.length(text).cast("bigint")))
    kept = _between(text, F.zip_with(left, right, lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    labels = F.concat(F.transform(found, lambda c: F.element_at(names, c["kind"] + 1)), F.array(F.lit("")))
    built = F.array_join(F.zip_with(kept, labels, lambda k, name: F.concat(k, name)), "")
    marked = df.withColumn("__cofreq_spans", F.when(text.rlike("|".join(f"(?:{n})" for n in (*NEEDS.values(), *MORE_NEEDS.values()))), merged(spans)))
    return marked.withColumn(text_col, F.when(F.size(found) > 0, built).otherwise(text)).drop("__cofreq_spans")
