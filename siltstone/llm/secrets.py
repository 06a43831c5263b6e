"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order Markov models over character classes (a letter, digit or mark each) are trained from labelled samples:
random strings and ordinary identifiers. A token's score is the mean log-likelihood ratio of its transitions; tokens over
the threshold become spans beside those of the patterns. Training counts transitions with DataFrame operations, and the
ratio table (a few thousand numbers at most, whatever the corpus) becomes a literal in the scanning expression. Nothing
but SQL expressions runs on the texts, and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which they are listed: (name, pattern, least length, group that has that length).
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"(AKIA[A-Z0-9]+)", 20, 1),
    ("hex", r"([0-9a-f]+)", 24, 1),
)
#: What a text must hold for a kind to be worth looking for: the pattern with its least length where that is the same.
HINTS = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: Tokens that the models look at: long enough for a mean of transitions to mean something. Under LONG_TOKEN the mean has to
#: be higher in proportion: the sum of a token that short has to reach what one of LONG_TOKEN needs.
LEAST_TOKEN, LONG_TOKEN = 12, 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
TOKEN_HINT = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN}}}"
THRESHOLD = 0.9
#: Words of ordinary identifiers, fixed values.
WORDS = (
    "account active add address admin after all amount and api app array async auth author available average back base batch before begin "
    "block body bool buffer build button byte cache call cancel case category center change channel char check child class clean clear "
    "click client close cluster code color column command comment commit common compare complete component config connect constant "
    "container content context control convert copy core count country create current cursor custom customer data database date day "
    "debug default delete delta depth description detail device dict digit dir disable display distance document domain double down "
    "driver edge edit element email enable encode end engine entry env error event exception execute exit export extra factory fail "
    "feature field file filter final find first flag float flush folder font form format found frame from function get global graph "
    "group handle handler hash head header height help hidden history home host hour http icon image import index info init input insert "
    "instance int interface internal item iterator job join json key label language last layer layout left length level library limit "
    "line link list listener load local location lock log login long loop main manager map mask master match matrix max memory menu "
    "merge message method min minute mode model module monitor month mouse move name native network next node normal note null number "
    "object offset open operator option order origin output owner page panel parameter parent parse part password path pattern payload "
    "pending phone pipeline pixel point policy pool port position post power prefix previous price print private process product "
    "profile project property protocol provider proxy public push query queue random range rate read reader record reduce reference "
    "region register release remote remove render replace report request reset resource response result retry return right role root "
    "route row rule run sample save scale schedule schema score screen script search second section select sender sequence server "
    "service session set setting shape shard shared shift show signal simple single size sort source space spec split stack stage start "
    "state static status step stop storage store stream string style submit sum support switch sync system table tag target task "
    "template test text thread time timeout title token tool top total trace track transaction transform tree trigger type update "
    "upload user util valid value vector version video view visible wait warning web weight width window word worker wrapper write year zone"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (text, random): strings drawn from a seeded digest, and identifiers put together from words."""
    seed = F.col("id").cast("string")
    digest = F.concat(F.sha2(F.concat(F.lit("a"), seed), 512), F.sha2(F.concat(F.lit("b"), seed), 512))
    letters = F.regexp_replace(F.base64(F.unhex(digest)).cast("string"), "\\s", "")
    drawn = (
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 48))
        .when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(letters, "[+/=]", "")).substr(1, 40))
        .otherwise(letters.substr(1, 64))
    )
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    number = F.when(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) == 0, (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2100))).cast("string")).otherwise("")
    named = (
        F.when(F.col("id") % 3 == 0, F.concat_ws("_", word(1), word(2), word(3), word(4), number))
        .when(F.col("id") % 3 == 1, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), number))
        .otherwise(F.concat_ws("-", word(1), word(2), number, word(3), word(4)))
    )
    ids = spark.range(n, numPartitions=2)
    # one in five in capitals, as constants and headings are
    named = F.when(F.col("id") % 5 == 0, F.upper(named)).otherwise(named)
    return ids.select(drawn.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(named.alias("text"), F.lit(False).alias("random")))


def _codes(text: Column) -> Column:
    """Positions in the alphabet, from 1; 0 for any other character."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each transition: row by row, (len(ALPHABET) + 1) ** 2 numbers."""
    k = len(ALPHABET) + 1
    codes = labelled.select("random", _codes(F.col("text")).alias("c"))
    steps = codes.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * k + b)).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    table = []
    for a in range(k):
        total = {label: sum(counts.get((label, a * k + b), 0) for b in range(k)) for label in (True, False)}
        for b in range(k):
            p, q = ((counts.get((label, a * k + b), 0) + smoothing) / (total[label] + smoothing * k) for label in (True, False))
            table.append(round(math.log(p / q), 6))
    return table


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions. Its codes are read twice, whatever its length."""
    k = len(ALPHABET) + 1
    codes, steps = _codes(token), F.length(token) - 1
    each = F.zip_with(F.slice(codes, 1, F.greatest(steps, F.lit(0))), F.slice(codes, 2, F.greatest(steps, F.lit(0))), lambda a, b: F.element_at(table, a * k + b + 1))
    return F.when(steps > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / steps).otherwise(0.0)


def found(text: Column, pattern: str, kind: str, order: int, least: int, group: int, hint: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as structs; those whose group is under ``least`` go.

    Between matches lie the pieces that split() gives, so a match starts after all pieces up to its own and all matches
    before it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("len"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("value"),
    )
    kind_t = "struct<start:int,ord:int,kind:string,stop:int,value:string>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_t}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        stop = start + x["len"]
        hit = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    return F.when(text.rlike(hint), F.aggregate(parts, state, step, lambda s: s["out"])).otherwise(F.array().cast(f"array<{kind_t}>"))


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, base, random): arrays of the spans that patterns and models find in each text.

    Spans are structs (start, ord, kind, stop, value), ends exclusive, in code points. Null and empty texts have none.
    Tokens that touch a span of a pattern are that span's; equal rows give equal rows, an empty table none. Texts of any length are read whole;
    other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"))
    body = F.col("body")
    # a pattern that is one run of a class matches the same runs with its least length inside
    patterns = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
    rows = rows.select("doc_id", "body", *[found(body, patterns[kind], kind, i, least, group if kind == "assign" else 0, HINTS[i]).alias(kind) for i, (kind, _, least, group) in enumerate(KINDS)])
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("doc_id", "body", base.alias("base"))
    tokens = found(body, TOKEN, "random", len(KINDS), LEAST_TOKEN, 0, TOKEN_HINT)
    ratios = F.array(*[F.lit(x) for x in table])
    wanted = lambda t: threshold * F.greatest(F.lit(1.0), LONG_TOKEN / F.length(t))
    free = F.filter(
        tokens,
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])) & (ratio(t["value"], ratios) >= wanted(t["value"])),
    )
    return rows.select("doc_id", "base", free.alias("random"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(common.table(spark, sf_dir, "documents"), train(samples(spark)))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(kind) for kind, *_ in KINDS],
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
