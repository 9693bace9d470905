"""Personal data: fixed patterns, and bootstrapped contextual extraction. DataFrame functions only.

Base spans of four kinds (email, ip, card, phone) come from regular expressions with checks. They
are the seeds. Every identifier-shaped token (one with a digit or an @) is an instance; the one
and the two words before it, the two after it, and the words on both sides are its lexical
patterns (one word after it says too little). Patterns and instances form a graph whose edges count occurrences. Spark scores it
iteratively: a pattern's score for a kind is how much of what it surrounds, and what has the
kind's shape, is believed to be of that kind (smoothed); a pattern with ``SEEDS`` different
believed instances and a score of ``TRUST`` is trusted; what trusted patterns surround is
believed in turn, by the probability that one of them is right, and supports further patterns.
Rounds go on until no pattern is trusted that was not before: identifiers found by one pattern
lead to patterns that never stood beside a seed. Beliefs only grow, so the rounds end. Trusted
patterns mark those instances that they surround, have the kind's shape and overlap no base span.
Those are the discovered spans.

Positions are prefix sums of the lengths of the gaps between matches (``split``) and of the
matches, eight entries at a time; a token finds the base spans beside it by binary search; a
mask is cut out of blocks of the text. So time and memory grow with the text, times the logarithm
of its number of matches. Only texts with a digit or an @ are searched at all. Edges are counted
before they are shuffled, so a phrase that a third of all texts share is a few rows of each map
task. Hashes stand for patterns and instances. What is counted is far smaller than the texts, so it is
written by a task for each core, or for each 4 MB of what it is made from where that is more, not by
one for each shuffle partition: a file costs its executor processes where Hadoop's native library is
missing. What was found is written before it is joined, so that its size is known: where it is
small, no row of the base spans is shuffled.

Edge cases: null text is empty (the digest is that of the empty string); a very long text is one
row, like any other; of equally good kinds for a token the first listed holds; repeated rows of
one (doc_id, text) get equal results; null ids stay null; an empty table gives no rows. Only
doc_id and text are read, so other columns may have any names; ``mask`` carries them along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm._common import discard, input_bytes, materialise, narrow, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns as stated, made linear: possessive, and begun only where a match can begin.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An instance: words of digits apart by one space, or one word with a digit or an @.
TOKEN = (
    r"(?<![^\x20\x09-\x0D])(?:"
    r"[(+]{0,2}[0-9][0-9().-]*+(?:\x20[(+]?[0-9][0-9().-]*+)++(?![^\x20\x09-\x0D])"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
WORD, SPACE = r"[^\x20\x09-\x0D]++", r"[\x20\x09-\x0D]"
#: The last two words (or the only one) of a gap, and its first two.
BEFORE = rf"(?<![^\x20\x09-\x0D])(?:{WORD}{SPACE}++)?{WORD}{SPACE}*+$"
AFTER = rf"^{SPACE}*+{WORD}(?:{SPACE}++{WORD})?"
#: Least number of different believed instances behind a pattern, and the score that makes it trusted.
SEEDS = 4
TRUST = 0.8
#: A score is computed as if so many unbelieved instances had been seen as well.
DOUBT = 0.5
#: Code points in a block of a text that is masked.
BLOCK = 1024
#: Entries summed at once by a prefix sum, and rounds that cover any array.
FAN, DEPTH = 8, 10
SPANS = "array<struct<k:int,s:int,e:int>>"


def prefix(df: DataFrame, name: str, fold: str, zero: str) -> DataFrame:
    """``df`` with the array ``name`` replaced by its inclusive prefix folds under ``fold`` (of acc
    and x: their sum or maximum, with ``zero`` as neutral element): each round covers ``FAN`` times
    as many entries as the one before, and arrays that are covered pass through."""
    for level in range(DEPTH):
        step = FAN**level
        near = f"transform(sequence(0, {FAN - 1}), k -> coalesce(get({name}, i - k * {step}), {zero}))"
        wide = f"transform({name}, (v, i) -> aggregate({near}, {zero}, (acc, x) -> {fold}))"
        df = df.withColumn(name, F.expr(f"if(size({name}) > {step}, {wide}, {name})"))
    return df


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    doubled = F.aggregate(
        F.split(F.reverse(digits(v)), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda acc, d: F.struct(
            (acc["i"] + 1).alias("i"),
            (
                acc["sum"]
                + F.when(d == "", 0)
                .when(acc["i"] % 2 == 0, d.try_cast("int"))
                .otherwise((d.try_cast("int") * 2) % 10 + (d.try_cast("int") * 2 / 10).cast("int"))
            ).cast("int").alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return doubled % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        # numbers, however many leading zeros
        return F.forall(
            F.split(v, r"\."),
            lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
                "^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
            ),
        )
    n = F.length(digits(v))
    if kind == "card":
        return n.between(16, 19) & luhn(v)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def shapes(v: Column) -> Column:
    """The kinds whose identifiers a token could be, as bits."""
    n = F.length(digits(v))
    like = (
        v.rlike("[A-Za-z0-9]@[A-Za-z0-9]"),
        v.rlike("^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){2,}$") & (n >= 3),
        (n >= 12) & ~v.contains("@"),
        n.between(6, 15) & ~v.contains("@") & ~v.rlike("[A-Za-z]"),
    )
    return reduce(lambda x, y: x + y, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(like)])


def first_after(spans: str, at: str) -> str:
    """SQL for the index of the first of the sorted, disjoint ``spans`` that ends after ``at``."""
    below = f"get({spans}, shiftright(acc.lo + acc.hi, 1)).e <= {at}"
    half = (
        f"if(acc.lo >= acc.hi, acc, named_struct('lo', if({below}, shiftright(acc.lo + acc.hi, 1) + 1, acc.lo), "
        f"'hi', if({below}, acc.hi, shiftright(acc.lo + acc.hi, 1))))"
    )
    start = f"named_struct('lo', 0, 'hi', size({spans}))"
    steps = f"sequence(1, int(ceil(log2(size({spans}) + 1))))"
    return f"if(size({spans}) = 0, 0, aggregate({steps}, {start}, (acc, _) -> {half}, acc -> acc.lo))"


def _words(gap: Column, pattern: str) -> Column:
    """Up to two words of a gap, lower-cased, digits as zeros."""
    found = F.regexp_extract(gap, pattern, 0)
    return F.filter(F.split(F.lower(F.regexp_replace(found, "[0-9]", "0")), SPACE + "++"), lambda w: w != "")


def _patterns(t: Column) -> Column:
    """Hashes of the patterns around a token: a word or two before, two after, one on both sides."""
    made = [
        F.when(reduce(lambda x, y: x & y, [t[w].isNotNull() for w in words]), F.xxhash64(F.lit(tag), *[t[w] for w in words]))
        for tag, words in enumerate((["y1"], ["y2", "y1"], ["z1", "z2"], ["y1", "z1"]))
    ]
    return F.filter(F.array(*made), lambda p: p.isNotNull())


def _tokens() -> str:
    """SQL for the matches of ``TOKEN`` (v from..to) without edge punctuation (core s..e), and for
    each kind the first base span that ends after their beginning."""
    near = ", ".join(f"'b{k}', {first_after(f'_b{k}', 't.from')}" for k in range(len(KINDS)))
    lead = r"length(regexp_extract(t.v, r'^[^\p{L}\p{N}+]*+', 0))"
    core = r"regexp_replace(t.v, r'^[^\p{L}\p{N}+]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$', '')"
    placed = "transform(_v4, (v, i) -> named_struct('v', v, 'from', get(_w4, i) - length(v), 'to', get(_w4, i), 'n', i))"
    parts = f"'from', t.from, 'to', t.to, 'n', t.n, 's', t.from + {lead}, 'v', {core}, {near}"
    return f"transform({placed}, t -> named_struct({parts}))"


def _placed(t: Column) -> Column:
    """A token with its kind as a seed (-1: none; null if it continues a base span) and patterns."""
    touching, kind = F.lit(False), F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        one, two = (F.get(F.col(f"_b{k}"), t[f"b{k}"] + j) for j in (0, 1))
        inside = F.coalesce(one["s"] < t["to"], F.lit(False))
        begins = inside & ((one["s"] >= t["from"]) | F.coalesce(two["s"] < t["to"], F.lit(False)))
        touching, kind = touching | inside, F.when(begins, k).otherwise(kind)
    gaps = F.col("_gaps")
    return F.struct(
        t["s"].alias("s"), (t["s"] + F.length(t["v"])).alias("e"), t["v"].alias("v"), F.when(~touching, -1).otherwise(kind).alias("k"),
        _words(F.get(gaps, t["n"]), BEFORE).alias("y"), _words(F.get(gaps, t["n"] + 1), AFTER).alias("z"),
    )


def _named(t: Column) -> Column:
    """A token with its single words: the last two before it, the first two after."""
    y, z = t["y"], t["z"]
    return F.struct(
        t["s"].alias("s"), t["e"].alias("e"), t["v"].alias("v"), t["k"].alias("k"), F.try_element_at(y, F.lit(-1)).alias("y1"),
        F.when(F.size(y) > 1, F.get(y, F.lit(0))).alias("y2"), F.get(z, F.lit(0)).alias("z1"), F.get(z, F.lit(1)).alias("z2"),
    )


def _hashed(t: Column) -> Column:
    return F.struct(
        t["s"].alias("s"), t["e"].alias("e"), F.xxhash64(t["v"]).alias("i"), shapes(t["v"]).alias("m"), t["k"].alias("k"),
        _patterns(t).alias("ps"),
    )


def _less(base: str):
    return lambda e: (e - F.col(base)).cast("int")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, base and tokens of every row; texts without digit or @ are not searched."""
    text = F.coalesce("text", F.lit(""))
    body, strings = F.col("_text"), F.expr("cast(array() as array<string>)")
    digit = body.rlike("[0-9]")
    search = [*PATTERNS.values(), TOKEN]
    need = [F.contains(body, F.lit("@")), digit, digit, digit & F.contains(body, F.lit("+")), body.rlike("[0-9@]")]
    out = narrow(docs, "doc_id", "text").select("doc_id", text.alias("_text"), F.xxhash64(text).alias("tkey"))
    out = out.withColumns(
        {
            f"_v{k}": F.when(n, F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(strings)
            for k, (n, p) in enumerate(zip(need, search, strict=True))
        }
    )
    gaps = lambda k: F.split(body, search[k], -1)
    out = out.withColumn("_gaps", F.when(F.size("_v4") > 0, gaps(4)).otherwise(strings))
    lengths = lambda k, cut: F.zip_with(
        f"_v{k}", F.slice(cut, F.lit(1), F.size(f"_v{k}")), lambda v, g: (F.length(v) + F.length(g)).cast("long")
    )
    none = F.expr("cast(array() as array<bigint>)")
    made = [F.when(F.size(f"_v{k}") > 0, lengths(k, F.col("_gaps") if k == 4 else gaps(k))).otherwise(none) for k in range(5)]
    # one array of all five, whose prefix sums are taken at once
    out = prefix(out.withColumn("_ends", F.concat(*made)), "_ends", "acc + x", "0L")
    at, ends = F.lit(0), {}
    for k in range(5):
        base = F.coalesce(F.get("_ends", at - 1), F.lit(0))
        ends[f"_w{k}"] = F.struct(at.alias("at"), base.alias("base"))
        at = at + F.size(f"_v{k}")
    out = out.withColumns(ends).withColumns(
        {
            f"_w{k}": F.transform(
                F.slice("_ends", F.col(f"_w{k}.at") + 1, F.size(f"_v{k}")),
                _less(f"_w{k}.base"),
            )
            for k in range(5)
        }
    )

    def spans(k: int, kind: str) -> Column:
        found = F.zip_with(f"_v{k}", f"_w{k}", lambda v, e: F.struct(v.alias("v"), e.alias("e")))
        return F.transform(
            F.filter(found, lambda m: valid(kind, m["v"])),
            lambda m: F.struct(F.lit(k).alias("k"), (m["e"] - F.length(m["v"])).alias("s"), m["e"].alias("e")),
        )

    out = out.withColumns({f"_b{k}": spans(k, kind) for k, kind in enumerate(KINDS)})
    out = out.withColumn("_tokens", F.expr(_tokens()))
    for step in (_placed, _named, _hashed):
        out = out.withColumn("_tokens", F.transform("_tokens", step))
    return out.select(
        "doc_id",
        "tkey",
        F.concat(*[f"_b{k}" for k in range(len(KINDS))]).cast(SPANS).alias("base"),
        F.filter("_tokens", lambda t: t["k"].isNotNull() & (t["e"] > t["s"])).alias("tokens"),
    )


def graph(spans: DataFrame) -> DataFrame:
    """Edges (p, i, m, k, n): pattern, instance, its shapes, its kind as a seed (else -1), occurrences."""
    return (
        spans.select(F.explode("tokens").alias("t"))
        .select(F.explode("t.ps").alias("p"), "t.i", "t.m", "t.k")
        .filter((F.col("k") >= 0) | (F.col("m") > 0))
        .groupBy("p", "i", "m", "k")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fits(kind: Column | int) -> Column:
    """Whether a token has the shape of the kind."""
    bit = F.lit(1 << kind) if isinstance(kind, int) else F.expr("shiftleft(1, kind)")
    return F.col("m").bitwiseAND(bit) != 0


def scored(edges: DataFrame, believed: DataFrame | None) -> DataFrame:
    """(p, kind, score) of the patterns that are trusted, given the instances believed so far."""
    kinds = range(len(KINDS))
    if believed is not None:
        edges = edges.join(believed, "i", "left")
    belief = [
        F.when(F.col("k") == k, 1.0)
        .when((F.col("k") >= 0) | ~_fits(k), 0.0)
        .otherwise(F.lit(0.0) if believed is None else F.coalesce(f"b{k}", F.lit(0.0)))
        for k in kinds
    ]
    seen = [F.when((F.col("k") == k) | _fits(k), F.col("n")).otherwise(0) for k in kinds]
    out = edges.groupBy("p").agg(
        *[(F.sum(F.col("n") * b) / (F.sum(w) + DOUBT)).alias(f"a{k}") for k, b, w in zip(kinds, belief, seen, strict=True)],
        *[F.sum(F.when(b >= TRUST, 1).otherwise(0)).alias(f"s{k}") for k, b in zip(kinds, belief, strict=True)],
    )
    best = F.sort_array(
        F.array(*[F.struct(F.when(F.col(f"s{k}") >= SEEDS, F.col(f"a{k}")).otherwise(0.0).alias("score"), F.lit(-k).alias("k")) for k in kinds]),
        asc=False,
    )[0]
    return out.select("p", (-best["k"]).alias("kind"), best["score"].alias("score")).filter(F.col("score") >= TRUST)


def believed_instances(edges: DataFrame, trusted: DataFrame) -> DataFrame:
    """(i, b0 ..): for each kind the probability that one of the trusted patterns around is right."""
    doubt = lambda k: F.sum(F.when(F.col("kind") == k, F.log1p(-F.least("score", F.lit(0.999)))).otherwise(0.0))
    return (
        edges.filter("k < 0")
        .join(trusted, "p")
        .filter(_fits(F.col("kind")))
        .groupBy("i")
        .agg(*[(1 - F.exp(doubt(k))).alias(f"b{k}") for k in range(len(KINDS))])
    )


def _counted(df: DataFrame, source: DataFrame, label: str) -> DataFrame:
    """``df``, counted from the files of ``source``, materialised by a task for each core, or each 4 MB of ``source``."""
    return materialise(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, input_bytes(source) >> 22)), label)


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """(p, kind, score) of the patterns that are trusted once no further one becomes so; ``edges`` are files."""
    # a pattern with fewer different instances can never have enough that are believed
    enough = edges.groupBy("p").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= SEEDS).select("p")
    live = _counted(edges.join(enough, "p", "left_semi"), edges, "pii-graph")
    trusted, known = _counted(scored(live, None), live, "pii-trusted"), 0
    while (now := trusted.count()) > known:
        known = now
        believed = _counted(believed_instances(live, trusted), live, "pii-believed")
        after = _counted(scored(live, believed), live, "pii-trusted")
        discard(trusted), discard(believed)
        trusted = after
    discard(live)
    return trusted


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text), base and found spans: arrays of (k, s, e)."""
    spans = materialise(base_spans(docs), "pii-base")
    edges = _counted(graph(spans), spans, "pii-edges")
    trusted = trusted_patterns(edges)
    discard(edges)
    open_tokens = (
        spans.select("doc_id", "tkey", F.explode("tokens").alias("t"))
        .filter("t.k < 0")
        .select("doc_id", "tkey", "t.s", "t.e", "t.m", F.explode("t.ps").alias("p"))
    )
    found = (
        open_tokens.join(trusted, "p")
        .filter(_fits(F.col("kind")))
        .groupBy("doc_id", "tkey", "s", "e")
        .agg((-F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"]).alias("k"))
        .groupBy("doc_id", "tkey")
        .agg(F.sort_array(F.collect_set(F.struct("k", "s", "e"))).alias("found"))
        .withColumnsRenamed({"doc_id": "_doc", "tkey": "_tkey"})
    )
    found = _counted(found, spans, "pii-found")
    discard(trusted)
    return spans.join(
        found,
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_tkey")),
        "left",
    ).select("doc_id", "tkey", "base", F.coalesce("found", F.expr(f"cast(array() as {SPANS})")).alias("found"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind and start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    found = extract(docs)
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def with_masked(df: DataFrame, text: str, spans: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: ``text`` with each span replaced by its kind in brackets.

    Spans are taken by start; one that begins inside those before it is masked with them. The text
    is cut into blocks once, so that no span is looked for from the text's beginning.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    df = df.withColumns(
        {
            "_spans": F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))),
            "_blocks": F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)),
        }
    )
    df = prefix(df.withColumn("_upto", F.transform("_spans", lambda x: x["e"])), "_upto", "greatest(acc, x)", "0")

    def between(a: Column, b: Column) -> Column:
        """The code points from a to b: the end of a block, whole blocks, the beginning of one."""
        first, last = F.shiftright(a, BLOCK.bit_length() - 1), F.shiftright(b, BLOCK.bit_length() - 1)
        at, to = a - first * BLOCK, b - last * BLOCK
        block = lambda i: F.coalesce(F.get("_blocks", i), F.lit(""))
        return F.when(first == last, F.substring(block(first), at + 1, to - at)).otherwise(
            F.concat(
                F.substring(block(first), at + 1, F.lit(BLOCK)),
                F.array_join(F.slice("_blocks", first + 2, last - first - 1), ""),
                F.substring(block(last), F.lit(1), to),
            )
        )

    before = lambda i: F.coalesce(F.get("_upto", i - 1), F.lit(0))
    parts = F.transform(
        "_spans",
        lambda x, i: F.when(x["s"] >= before(i), F.concat(between(before(i), x["s"]), F.get(names, x["k"]))).otherwise(""),
    )
    rest = between(F.coalesce(F.try_element_at("_upto", F.lit(-1)), F.lit(0)), F.length(text))
    return df.withColumn(name, F.concat(F.array_join(parts, ""), rest)).drop("_spans", "_blocks", "_upto")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by its kind; n_chars follows, if there."""
    spans = (
        extract(docs)
        .select("doc_id", "tkey", F.concat("base", "found").alias("_found"))
        .filter(F.size("_found") > 0)
        .dropDuplicates(["doc_id", "tkey"])
        .withColumnsRenamed({"doc_id": "_doc", "tkey": "_tkey"})
    )
    # the row travels as one struct, so that no name in it can clash
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = row.join(
        spans,
        F.col("_row.doc_id").eqNullSafe(F.col("_doc"))
        & (F.xxhash64(F.coalesce("_row.text", F.lit(""))) == F.col("_tkey")),
        "left",
    ).select("_row", F.col("_found").isNotNull().alias("_has"), F.coalesce("_found", F.expr(f"cast(array() as {SPANS})")).alias("_found"),
             F.when(F.col("_found").isNotNull(), F.col("_row.text")).alias("_body"))
    out = with_masked(out, "_body", "_found", "_masked")
    text = F.when(F.col("_has"), F.col("_masked")).otherwise(F.col("_row.text"))
    columns = {c: F.col("_row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        changed = F.length("_masked").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("_has"), changed).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
