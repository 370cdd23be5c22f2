"""Fill-in-middle transformation of documents with piece tables, in column expressions.

A document becomes a table of pieces: (buffer, start, length) over two buffers that never change, the text and the
sentinels. Cutting splits a piece, an arrangement permutes pieces, and the output is what the pieces name, one
after the other. Restoring cuts the output at its sentinels and permutes back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import only

TEXT, SENTINELS = 0, 1


@dataclass(frozen=True)
class Middle:
    """How documents are transformed. Sentinels must not be empty, nor end with the beginning of one of them."""

    seed: int = 7
    rate: int = 100        # per cent of documents that are transformed
    spm_rate: int = 50     # per cent of these that begin with the suffix
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for a in self.sentinels:
            for b in self.sentinels:
                if not a or any(b.startswith(a[i:]) for i in range(1, len(a))) or a != b and a in b:
                    raise ValueError("sentinels are empty or overlap")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def order(self, form: str) -> list[str]:
        """Names of the pieces of an arrangement, sentinels by their upper-case names."""
        return {"plain": ["prefix", "middle", "suffix"], "psm": ["P", "prefix", "S", "suffix", "M", "middle"],
                "spm": ["S", "suffix", "P", "prefix", "M", "middle"]}[form]


def piece(buffer: int, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("int").alias("start"), length.cast("int").alias("length"))


def named_by(pieces: Column, text: Column, sentinels: str) -> Column:
    """The text that a piece table names; starts count code points from 0."""
    source = lambda p: F.when(p["buffer"] == TEXT, text).otherwise(F.lit(sentinels))
    return F.array_join(F.transform(pieces, lambda p: F.substring(source(p), p["start"] + 1, p["length"])), "")


def units(text: Column) -> Column:
    """Number of lines: each ends with its line end, the last one perhaps without."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def end_of(text: Column, n: Column) -> Column:
    """Code points of the first ``n`` lines."""
    before = F.length(F.call_function("substring_index", text, F.lit("\n"), n.cast("int")))
    return F.when(n <= 0, 0).otherwise(F.least(before + 1, F.length(text)))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four whole numbers below 2^32 that depend on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, how: Middle = Middle(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts whole texts into prefix, middle and suffix at line ends and rearranges them.

    Returns doc_id, n (lines), form (``plain``, ``psm`` or ``spm``), prefix_chars and middle_chars (code points; NULL
    if plain), pieces (the piece table) and output, one row per input row. Where the cuts fall depends on the seed,
    the id and the number of lines. Empty texts and texts that hold a sentinel stay plain; a NULL text is the empty
    text, a NULL id counts as the empty string. Repeated rows give equal rows; no rows give none; further columns
    are not read. Texts are never cut short; nothing shuffles.
    """
    rows = only(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(how.seed, F.col("doc_id"))
    holds = F.lit(False)
    for sentinel in how.sentinels:
        holds = holds | F.contains("text", F.lit(sentinel))
    drawn = rows.withColumn("n", units(F.col("text"))).withColumns({"_a": h1 % (F.col("n") + 1), "_b": h2 % (F.col("n") + 1)})
    plain = (F.col("text") == "") | holds | (h3 % 100 >= how.rate)
    cut = drawn.select(
        "doc_id", "text", "n",
        F.when(plain, "plain").when(h4 % 100 < how.spm_rate, "spm").otherwise("psm").alias("form"),
        end_of(F.col("text"), F.least("_a", "_b")).alias("_first"),
        end_of(F.col("text"), F.greatest("_a", "_b")).alias("_second"),
        F.length("text").alias("_end"),
    )
    buffer, at = "".join(how.sentinels), 0
    table = {
        "prefix": piece(TEXT, F.lit(0), F.col("_first")),
        "middle": piece(TEXT, F.col("_first"), F.col("_second") - F.col("_first")),
        "suffix": piece(TEXT, F.col("_second"), F.col("_end") - F.col("_second")),
    }
    for name, sentinel in zip("PSM", how.sentinels):
        table[name] = piece(SENTINELS, F.lit(at), F.lit(len(sentinel)))
        at += len(sentinel)
    arranged = {form: F.array(*[table[name] for name in how.order(form)]) for form in ("psm", "spm")}
    whole = F.array(piece(TEXT, F.lit(0), F.col("_end")))
    pieces = F.when(F.col("form") == "psm", arranged["psm"]).when(F.col("form") == "spm", arranged["spm"]).otherwise(whole)
    changed = F.col("form") != "plain"
    return cut.withColumn("pieces", pieces).select(
        "doc_id", "n", "form",
        F.when(changed, F.col("_first")).cast("long").alias("prefix_chars"),
        F.when(changed, F.col("_second") - F.col("_first")).cast("long").alias("middle_chars"),
        "pieces",
        F.when(changed, named_by(F.col("pieces"), F.col("text"), buffer)).otherwise(F.col("text")).alias("output"),
    )


def restore(made: DataFrame, how: Middle = Middle(), output: str = "output", form: str = "form") -> DataFrame:
    """Adds ``restored``, the text before the transformation, from the output and its form alone.

    The output is cut at its sentinels, which occur once each as transformed texts hold none, into a piece table
    over itself; the inverse permutation puts the pieces into the order of the text. NULL gives NULL.
    """
    out, shape = F.col(f"`{output}`"), F.col(f"`{form}`")

    def back(form: str) -> Column:
        order = how.order(form)
        ends, starts = {}, {}
        for mark, part in zip(order[::2], order[1::2]):
            sentinel = how.sentinels["PSM".index(mark)]
            place = F.locate(sentinel, out) - 1
            starts[part], ends[part] = place + len(sentinel), place
        begins = list(starts)  # parts in the order of the output; one ends where the next sentinel begins
        limits = {a: ends[b] for a, b in zip(begins, begins[1:])} | {begins[-1]: F.length(out)}
        pieces = F.array(*[piece(TEXT, starts[p], limits[p] - starts[p]) for p in how.order("plain")])
        return named_by(pieces, out, "")

    return made.withColumn("restored", F.when(shape == "psm", back("psm")).when(shape == "spm", back("spm")).otherwise(out))


def digests(made: DataFrame) -> DataFrame:
    """The columns of a transformation with SHA-256 sums of output and restored text in place of the texts."""
    return restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def sql() -> str:
    """DuckDB SQL of the digests with the default parameters; lines are matched by their pattern."""
    return """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    l AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS lines,
        [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM d),
    c AS (SELECT *, CAST(len(lines) AS BIGINT) AS n,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
             WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS a,
        greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS b FROM l),
    p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
        array_to_string(lines[b + 1:], '') AS suffix FROM c)
    SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM p
    """
