"""Secret scans: fixed formats, and a Markov test for random strings.

Two first-order character models, one of random strings and one of ordinary identifiers and
words, are trained from labelled samples. A run of token characters is a secret if the
log-likelihood ratio of the two models is high enough. Built-in functions only; the trained ratio
is a table of 128 x 128 integers whatever the corpus, and texts are scanned where they lie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import set_aside, text_of, with_results

#: Fixed formats: kind, pattern, group whose length counts, least length; in order of kind.
FORMATS = [
    (
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Runs that the models judge, whole or what a fixed format leaves of them, and their least length.
LEAST_RUN = 16
RUN = rf"[A-Za-z0-9+/=_-]{{{LEAST_RUN},}}"
ORDINARY = r"[A-Za-z0-9+/=_-]{6,}"
#: About this many documents, picked by a hash of the id, give the labelled samples.
TRAIN_DOCS = 4000
#: Generated random strings that join the random samples, of each alphabet: hexadecimal digits with
#: small letters, with capitals, and base64.
RANDOM_STRINGS = 2000
#: Generated ordinary samples: numbers of about 40 digits, and pairs of each repeated character.
NUMBERS, REPEATS = 500, 200
REPEATED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Ratio of a secret in nats: in all, and for each pair of characters.
MIN_RATIO = 14.0
MIN_RATIO_PER_PAIR = 1.0
SCALE = 1000
KINDS = ["assign", "access", "hex", "markov"]
MARK = "[SECRET]"


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern, and the pieces between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return matches, F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array())


def _spans(kind: int, matches: Column, pieces: Column, lengths: Column) -> Column:
    """Spans of matches, in code points; `lengths` is the length that each is judged by."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,n:int>>").alias("out")
    )
    steps = F.zip_with(
        F.slice(pieces, 1, F.size(matches)),
        F.arrays_zip(matches.alias("m"), lengths.alias("n")),
        lambda piece, m: F.struct(
            F.length(piece).alias("gap"), F.length(m["m"]).alias("size"), m["n"].alias("n")
        ),
    )

    def step(state, x):
        s = state["at"] + x["gap"]
        span = F.struct(
            s.alias("s"), F.lit(kind).alias("k"), (s + x["size"]).alias("e"), x["n"].alias("n")
        )
        return F.struct(
            (s + x["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out")
        )

    return F.aggregate(steps, start, step)["out"]


def _at_least(length: int):
    return lambda x: x["n"] >= length


def _touch(a: Column, b: Column) -> Column:
    """Whether two spans share a character."""
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _remainders(run: Column, base: Column) -> Column:
    """(s, e) of the parts of a run outside the spans that touch it, LEAST_RUN characters or more."""
    touching = F.filter(F.sort_array(base), lambda b: _touch(run, b))
    free = F.aggregate(
        touching,
        F.struct(run["s"].alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda state, b: F.struct(
            F.greatest(state["at"], b["e"]).alias("at"),
            F.concat(
                state["out"], F.array(F.struct(state["at"].alias("s"), b["s"].alias("e")))
            ).alias("out"),
        ),
        lambda state: F.concat(
            state["out"], F.array(F.struct(state["at"].alias("s"), run["e"].alias("e")))
        ),
    )
    return F.filter(free, lambda x: x["e"] - x["s"] >= LEAST_RUN)


def _with_base(docs: DataFrame) -> DataFrame:
    """`docs` with __base, the spans of the fixed formats; __text is scanned."""
    parts, empty = [], F.array().cast("array<struct<s:int,k:int,e:int,n:int>>")
    for k, (_, pattern, _, _) in enumerate(FORMATS):
        docs = docs.withColumn(f"__m{k}", _found(F.col("__text"), pattern)[0])
    for k, (_, pattern, group, least) in enumerate(FORMATS):
        matches, text = F.col(f"__m{k}"), F.col("__text")
        counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        found = _spans(
            k, matches, F.split(text, pattern, -1), F.transform(counted, lambda x: F.length(x))
        )
        # The filter's lambda has one parameter: Spark would take a second one as the place.
        enough = F.filter(found, _at_least(least))
        parts.append(F.when(F.size(matches) > 0, enough).otherwise(empty))
    return docs.withColumn("__base", F.concat(*parts))


def _pairs(tokens: Column) -> Column:
    """Codes of neighbouring characters of ASCII strings, 128 * first + second."""
    codes = F.transform(F.split(tokens, ""), lambda c: F.ascii(c))
    return F.zip_with(
        F.slice(codes, 1, F.size(codes) - 1),
        F.slice(codes, 2, F.size(codes) - 1),
        lambda a, b: a * 128 + b,
    )


def train(docs: DataFrame) -> list[int]:
    """Log-likelihood ratio of each pair of characters, in 1/1000 nats.

    Random samples are the matches of the fixed formats and generated strings; ordinary samples
    are the other runs of token characters of the sampled documents, generated numbers, and lines
    of one repeated character. No documents leave the generated strings alone. Null ids fall into the sample or out
    of it together, as do repeated ones; only counts of pairs reach the driver.
    """
    total = docs.count()
    share = min(1.0, TRAIN_DOCS / max(total, 1))
    sample = (
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        .select(text_of(F.col("text")).alias("__text"))
        .transform(_with_base)
    )
    value = lambda s: F.transform(
        F.filter("__base", lambda x: x["k"] > 0),
        lambda x: F.substring(F.col("__text"), x["s"] + 1, x["e"] - x["s"]),
    )
    secret = sample.select(F.explode(value("__base")).alias("t"), F.lit(True).alias("random"))
    plain = sample.filter(F.size("__base") == 0).select(
        F.explode(F.regexp_extract_all("__text", F.lit(ORDINARY), F.lit(0))).alias("t"),
        F.lit(False).alias("random"),
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(0, RANDOM_STRINGS, 1, 2).select(
        F.explode(F.array(digest, F.upper(digest), F.rtrim(F.base64(F.unhex(digest)), F.lit("=")))).alias("t"),
        F.lit(True).alias("random"),
    )
    number = F.regexp_replace(F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 256), "[a-f]", "")
    fills = F.transform(
        F.split(F.lit(REPEATED), ""), lambda c: F.repeat(c, F.lit(REPEATS + 1))
    )
    spark = docs.sparkSession
    ordinary = (
        spark.range(0, NUMBERS, 1, 2).select(number.alias("t"))
        .union(spark.range(0, 1, 1, 1).select(F.explode(fills).alias("t")))
        .select("t", F.lit(False).alias("random"))
    )
    counts = (
        secret.union(plain)
        .union(made)
        .union(ordinary)
        .select("random", F.explode(_pairs(F.col("t"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()  # at most 2 * 128 * 128 rows
    )
    seen = np.zeros((2, 128, 128))
    for row in counts:
        seen[int(row["random"])].flat[row["pair"]] += row["count"]
    smooth = seen + 0.5
    chance = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    return np.rint(SCALE * (chance[1] - chance[0])).astype(int).ravel().tolist()


def scan(docs: DataFrame, model: list[int]) -> DataFrame:
    """`docs` with n_assign, n_access, n_hex, n_markov (bigint), base_sha256, spans (string) and
    secret_spans (array of start, kind, end), in place of columns of these names.

    Spans count code points, ends are exclusive, order is by start, then kind. Null texts are
    empty: no spans and the digest of nothing. Of a run that touches spans of a fixed format, the
    parts outside them are judged one by one, so added spans never overlap those. Texts of any
    length are scanned whole. Null ids, repeated rows and other columns pass through, whatever
    their names.
    """
    frame, own = set_aside(docs, __text=text_of(F.col("text")))
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    ratio = lambda run: F.aggregate(
        _pairs(run), F.lit(0), lambda total, pair: total + F.get(table, pair)
    )
    based = frame.transform(_with_base).withColumn("__m", _found(F.col("__text"), RUN)[0])
    none = F.array().cast("array<struct<s:int,k:int,e:int,n:int>>")
    random = lambda x: (x["n"] >= int(MIN_RATIO * SCALE)) & (
        x["n"] >= int(MIN_RATIO_PER_PAIR * SCALE) * (x["e"] - x["s"] - 1)
    )
    scored = based.withColumn("__ratios", F.transform("__m", ratio))
    runs = F.filter(_spans(3, F.col("__m"), F.split("__text", RUN, -1), F.col("__ratios")), random)
    some = F.exists("__ratios", lambda x: x >= int(MIN_RATIO * SCALE))
    # Where a fixed format was found, runs carry their place until its spans are cut out of them.
    placed = F.zip_with(
        _spans(3, F.col("__m"), F.split("__text", RUN, -1), F.col("__ratios")),
        F.col("__m"),
        lambda x, m: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["n"].alias("n"), m.alias("m")),
    )
    span = lambda s, e, n: F.struct(
        s.alias("s"), F.lit(3).alias("k"), e.alias("e"), n.alias("n")
    )
    parts = F.flatten(
        F.transform(
            placed,
            lambda x: F.when(
                F.exists("__base", lambda b: _touch(x, b)),
                F.transform(
                    _remainders(x, F.col("__base")),
                    lambda r: span(
                        r["s"], r["e"], ratio(F.substring(x["m"], r["s"] - x["s"] + 1, r["e"] - r["s"]))
                    ),
                ),
            ).otherwise(F.array(span(x["s"], x["e"], x["n"]))),
        )
    )
    both = (F.size("__base") > 0) & (F.size("__m") > 0)
    added = F.when(both, F.filter(parts, random)).when(some, runs).otherwise(none)
    every = scored.withColumn("__added", added).withColumn(
        "__all", F.sort_array(F.concat("__base", "__added"))
    )
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(
        F.transform(
            spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
        ),
        ",",
    )
    count = lambda k: F.size(F.filter("__all", lambda x: x["k"] == k)).cast("bigint")
    return with_results(
        every,
        own,
        {f"n_{kind}": count(k) for k, kind in enumerate(KINDS)}
        | {
            "base_sha256": F.sha2(listed(F.sort_array("__base")), 256),
            "spans": listed(F.col("__all")),
            "secret_spans": F.transform(
                "__all",
                lambda x: F.struct(
                    x["s"].alias("start"), F.get(names, x["k"]).alias("kind"), x["e"].alias("end")
                ),
            ),
        },
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every secret replaced by MARK and n_chars counted anew; all rows stay.

    The models are trained on `docs`. Overlapping spans are replaced together.
    """
    found = scan(docs.select("doc_id", "text", F.struct("*").alias("__row")), train(docs))
    text = text_of(F.col("text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, x):
        between = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        apart = x["start"] >= state["at"]
        return F.struct(
            F.greatest(x["end"], state["at"]).alias("at"),
            F.when(apart, F.concat(state["out"], between, F.lit(MARK)))
            .otherwise(state["out"])
            .alias("out"),
        )

    marked = F.aggregate(
        "secret_spans",
        start,
        step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    clean = found.select(
        F.when(F.size("secret_spans") > 0, marked).otherwise(F.col("text")).alias("__clean"), "__row"
    )
    columns = {
        "text": F.col("__clean"),
        "n_chars": F.length("__clean").cast("bigint"),
    }
    return clean.select(
        *[
            columns.get(c.lower(), F.col(f"__row.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )


def query(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each document."""
    return scan(docs.select("doc_id", "text"), train(docs)).drop("text", "secret_spans")
