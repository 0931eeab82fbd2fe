"""Personal data: base patterns, and high-recall candidates judged by boosted trees.

Generators propose spans that may overlap. Each candidate gets format features (lengths,
counts of kinds of characters, a checksum) and context features (words before it).
Boosted trees score it; a threshold calibrated on held-out examples selects it.
The training examples are made up here, by templates with a known answer, because
no table labels spans; the model is small and trained on the driver. It reaches the
executors as an expression, so only DataFrame functions run on the rows.
"""

from __future__ import annotations

import functools
import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import collected, documents, no_places, outermost, places

#: Kinds of the base in their order, each with its pattern (possessive, and bound to
#: the start of a run, so that long runs take linear time and no stack) and a cheap test that precedes it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

#: Candidates: kind, cheap test (text held, or a pattern), pattern. They are high in recall, not in precision.
CANDIDATES = (
    ("email", r"(?i)[\[( ]at[\]) ]", r"(?i)(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,}+ ?[\[(]? ?\bat\b ?[\])]? ?[A-Za-z0-9-]{2,}+(?: ?[\[(]? ?(?:\bdot\b|\.) ?[\])]? ?[A-Za-z]{2,}+)+"),
    ("phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    ("secret", r"[A-Za-z0-9_+/-]{20}", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"),
    ("national_id", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])"),
    ("mac", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:])"),
)
KIND_ORDER = (*BASE_KINDS, *dict.fromkeys(k for k, _, _ in CANDIDATES if k not in BASE_KINDS))
#: Words before a candidate that speak for it.
CUES = r"(?i)(?:token|secret|passw|api.?key|\bkey\b|bearer|auth|credential|private|tel|phone|call|mobile|fax|ssn|social|security|tax|iban|account|bank|mail|contact|reach|write|mac|address|device)"
FEATURES = 10


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _base(text: Column) -> dict[str, Column]:
    """Places of each base kind, checked."""
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
    luhn = lambda s: F.when(F.length(digits(s)).between(16, 19), _luhn(digits(s))).otherwise(False)
    found = {
        "email": F.when(F.contains(text, F.lit("@")), places(text, EMAIL)),
        "ip": F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(places(text, IP), lambda x: F.forall(F.split(x["text"], r"\.", -1), part))),
        "card": F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")), F.filter(places(text, CARD), lambda x: luhn(x["text"]))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(places(text, PHONE), lambda x: F.length(digits(x["text"])).between(8, 15))),
    }
    return {k: F.coalesce(c, no_places()) for k, c in found.items()}


def _spans(kind: str, found: Column) -> Column:
    order = KIND_ORDER.index(kind)
    return F.transform(found, lambda x: F.struct(F.lit(order).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _features(kind: str, span: Column, before: Column) -> list[Column]:
    """FEATURES integers of a candidate's text and of the 40 code points before it."""
    count = lambda p: F.regexp_count(span, F.lit(p)).cast("int")
    return [
        F.lit(KIND_ORDER.index(kind)),
        F.length(span),
        count("[0-9]"),
        count("[A-Z]"),
        count("[a-z]"),
        count(r"[+/_-]"),
        F.size(F.array_distinct(F.split(F.lower(span), ""))),
        F.rlike(before, F.lit(CUES)).cast("int"),
        F.rlike(before, F.lit(r"[=:][\s\"']*$")).cast("int"),
        F.rlike(span, F.lit(r"^[0-9a-f]+$|^[0-9A-F]+$")).cast("int"),
    ]


def _candidates(text: Column) -> Column:
    """All candidate spans with their features."""

    def shaped(kind: str):
        def one(x: Column) -> Column:
            before = F.substring(text, F.greatest(x["start"] - 39, F.lit(1)), F.least(x["start"], F.lit(40)))
            rank = F.lit(KIND_ORDER.index(kind)).alias("rank")
            return F.struct(rank, x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), F.array(*_features(kind, x["text"], before)).alias("f"))

        return one

    none = F.array().cast("array<struct<rank:int,start:int,stop:int,kind:string,f:array<int>>>")
    found = [F.transform(F.when(F.rlike(text, F.lit(test)), places(text, pattern)), shaped(kind)) for kind, test, pattern in CANDIDATES]
    return F.flatten(F.array(*[F.coalesce(x, none) for x in found]))


def _examples(n: int, seed: int) -> list[tuple[str, int]]:
    """Texts, each with one made-up item in made-up prose, and whether the item is personal or secret."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "de", "ti", "on", "re", "er", "st", "la", "ou", "en")) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 9)))
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    figures, hexes = "0123456789", "0123456789abcdef"
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    made = [
        lambda: (f'{r.choice(("token", "secret", "api_key", "password", "auth key"))}{r.choice((" = ", ": ", "="))}"{pick(hexes, r.choice((32, 40, 64)))}"', 1),
        lambda: (f'{r.choice(("token", "secret", "API key", "credential"))}{r.choice((" = ", ": ", " "))}{pick(base64, r.randint(20, 64))}', 1),
        lambda: (f"AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 16)}", 1),
        lambda: (pick(hexes, r.choice((32, 40, 64))), 1),
        lambda: (f"{word()}{r.randint(1, 99)} {r.choice(('at', '[at]', '(at)'))} {word()} {r.choice(('dot', '[dot]', '(dot)'))} {r.choice(('com', 'org', 'net'))}", 1),
        lambda: (f"{r.choice(('mail me', 'contact', 'write to', 'reach'))} {word()} at {word()} dot {r.choice(('com', 'org'))}", 1),
        lambda: (f"{r.choice(('call', 'tel', 'phone', 'at', ''))} ({pick(figures, 3)}) {pick(figures, 3)}-{pick(figures, 4)}", 1),
        lambda: (f"{r.choice(('call', 'mobile:', 'fax', 'on'))} {pick(figures, 3)}-{pick(figures, 3)}-{pick(figures, 4)}", 1),
        lambda: (f"{r.choice(('SSN', 'social security', 'tax id', ''))} {pick(figures, 3)}-{pick(figures, 2)}-{pick(figures, 4)}", 1),
        lambda: (f"{r.choice(('IBAN', 'account', 'bank', ''))} {r.choice(('DE', 'GB', 'FR', 'ES'))}{pick(figures, 2)} {pick(figures, 4)} {pick(figures, 4)} {pick(figures, 4)} {pick(figures, 4)} {pick(figures, 2)}", 1),
        lambda: (f"{r.choice(('mac', 'address', 'device', ''))} {':'.join(pick(hexes, 2) for _ in range(6))}", 1),
        lambda: (f'{r.choice(("token", "secret", "bearer", "private key"))}{r.choice((" = ", ": ", " "))}{pick(base64, r.randint(65, 900))}', 1),
        lambda: (pick(base64.replace("+/", "-_"), r.randint(200, 900)), 1),
        # what looks alike and is neither personal nor secret
        lambda: ("".join(word() for _ in range(9))[:60].ljust(24, "a"), 0),
        lambda: ("-".join(word() for _ in range(8)), 0),
        lambda: ("/".join(word() for _ in range(9)), 0),
        lambda: ("_".join(word() + "on" for _ in range(6)).ljust(22, "a"), 0),
        lambda: (r.choice("-_=") * r.randint(20, 80), 0),
        lambda: (r.choice(("0", "1", "-0")) * r.randint(20, 40), 0),
        lambda: (f"{word()} at {word()}. {word()}", 0),
        lambda: (f"{word()}on at {word()}on.{word()[:10]}", 0),
        lambda: (f"{prose()} at {word()}. Th{word()[:8]}", 0),
        lambda: ("".join(word().capitalize() for _ in range(12))[:90], 0),
        lambda: (r.choice(("-", "_", "0", "1", "a", "-0", "ab")) * r.randint(100, 600), 0),
        lambda: (r.choice(("", "-", "/", "_")).join(word() for _ in range(r.randint(50, 200))), 0),
    ]
    out = []
    for i in range(n):
        item, good = made[i % len(made)]()
        out.append((f"{prose()} {item} {prose()}", good))
    return out


@lru_cache(maxsize=4)
def _model(n: int, seed: int, precision: float, _app: str):
    """Trees and threshold: half of the examples trains, the other half calibrates."""
    spark = SparkSession.getActiveSession()
    rows = json.dumps([{"i": i, "t": t, "y": y} for i, (t, y) in enumerate(_examples(n, seed))])
    made = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<i:int,t:string,y:int>>")).alias("x")).select("x.*")
    got = made.select("i", "y", F.explode(_candidates(F.col("t"))).alias("c")).select("i", "y", "c.f").orderBy("i").collect()  # at most a few a made-up text
    i, y, x = np.array([r[0] for r in got]), np.array([r[1] for r in got], float), np.array([r[2] for r in got], float)
    half = (i // 25) % 2 == 0
    trees = boosting.train(x[half], y[half])
    return trees, boosting.threshold(boosting.predict(trees, x[~half]), y[~half], precision)


SPAN = "struct<rank:int,start:int,stop:int,kind:string>"


def _with_spans(docs: DataFrame, text_col: str, n_examples: int, precision: float, seed: int) -> DataFrame:
    """docs with __base and __added: arrays of SPAN. Every column that a lambda reads stands in a projection of its own."""
    trees, cut = _model(n_examples, seed, precision, docs.sparkSession.sparkContext.applicationId)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({f"__of_{k}": _spans(k, found) for k, found in _base(text).items()} | {"__cands": _candidates(text)})
    score = lambda c: boosting.as_column(trees, [c["f"][i] for i in range(FEATURES)])
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(24))])

    def meets(c: Column, kind: str) -> Column:
        # spans of a kind lie one after another: the last that begins before c ends decides
        spans = F.col(f"__of_{kind}")
        n = F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(spans, at + half - 1)["start"] < c["stop"], half).otherwise(0))
        return F.coalesce(F.get(spans, n - 1)["stop"] > c["start"], F.lit(False))

    free = F.filter("__cands", lambda c: (score(c) >= F.lit(cut)) & ~functools.reduce(lambda a, b: a | b, [meets(c, k) for k in BASE_KINDS]))
    free = F.transform(free, lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind")))
    own = own.withColumn("__free", F.when(F.size("__cands") > 0, free).otherwise(F.array().cast(f"array<{SPAN}>")))
    longest_first = lambda x: F.struct(x["start"] - x["stop"], x["rank"])
    added = F.when(F.size("__free") > 1, F.array_sort(outermost(F.col("__free"), SPAN, longest_first))).otherwise(F.col("__free"))
    own = own.withColumns({"__base": F.flatten(F.array(*[f"__of_{k}" for k in BASE_KINDS])), "__added": added})
    return own.drop("__cands", "__free", *[f"__of_{k}" for k in BASE_KINDS])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_examples: int = 2100, precision: float = 0.98, seed: int = 3) -> DataFrame:
    """One row a document: doc_id, and base and added, arrays of (rank, start, stop, kind) in code points.

    An added span is a candidate that passes the threshold, overlaps no base span and lies within no other
    passing candidate. Null and empty texts have no spans. Rows are judged one by one: repeated
    rows give equal results, null ids pass through, an empty table gives an empty result, other columns are dropped.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_spans(own, "text", n_examples, precision, seed).select("doc_id", F.col("__base").alias("base"), F.col("__added").alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", n_examples: int = 2100, precision: float = 0.98, seed: int = 3) -> DataFrame:
    """docs with every found span of text_col replaced by its kind in angle brackets; of spans that overlap, what an earlier one leaves of a later goes with it.

    Rows are treated one by one, whatever their ids are. A null text stays null; other columns pass through.
    """
    text = F.col(text_col)
    sorted_ = F.array_sort(F.transform(F.array_union("__base", "__added"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    own = _with_spans(docs, text_col, n_examples, precision, seed).withColumn("__spans", sorted_).drop("__base", "__added")

    def step(acc: Column, s: Column):
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(before, F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
        return {"at": F.greatest(acc["at"], s["stop"])}, out

    pieces = collected(F.col("__spans"), {"at": F.lit(0)}, step, "string")
    tail = F.substring(text, F.array_max(F.col("__spans.stop")) + 1, F.length(text))
    done = F.concat(F.array_join(pieces, ""), tail)
    return own.withColumn(text_col, F.when(F.size("__spans") > 0, done).otherwise(text)).drop("__spans")


def op10_pii(spark, sf_dir):
    out = find_personal(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_sort("base")
    return out.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
