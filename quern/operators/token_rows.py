"""Token arrays: masks, packed rows, padding, attention, preference sides.

A packed row and its documents are one array each; a batch of documents is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.kernels import IGNORED, token_logprob
from quern.operators import next_fit

#: fixed chat form
PROMPT_FORM = ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n")
RESPONSE_FORM = ("", "<|im_end|>\n")


def serialise_prompt(prompt: Column, form: tuple[str, str] = PROMPT_FORM) -> Column:
    return F.concat(F.lit(form[0]), prompt, F.lit(form[1]))


def serialise_response(response: Column, form: tuple[str, str] = RESPONSE_FORM) -> Column:
    return F.concat(F.lit(form[0]), response, F.lit(form[1]))


def char_ids(text: Column) -> Column:
    """One id per character: the tokenizer of tests."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def masked_labels(ids: Column, prompt_length: Column, length: Column | None = None) -> Column:
    """`ids` with the prompt, and what lies beyond `length`, set to the ignored label."""
    end = F.size(ids) if length is None else length
    return F.transform(ids, lambda x, i: F.when((i < prompt_length) | (i >= end), F.lit(IGNORED)).otherwise(x).cast("long"))


def sft_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv_id, turn, prompt, response: each user turn that an assistant turn follows directly."""
    order = Window.partitionBy(conv).orderBy(turn)
    df = turns.withColumns({"__role": F.lead("role").over(order), "__text": F.lead("text").over(order)})
    return df.where((F.col("role") == "user") & (F.col("__role") == "assistant")).select(conv, turn, F.col("text").alias("prompt"), F.col("__text").alias("response"))


def pack_lengths(df: DataFrame, batch: str, order: str, length: str, max_len: int) -> DataFrame:
    """batch, order, row_no, start, end: where next-fit packing puts each document of a batch, whatever the batch's size.

    A document joins the open row if it fits with one separator, else opens the next; a longer one than a row is cut and
    alone unless a short one follows in the space left by none.
    """
    return next_fit.pack(df, batch, order, length, max_len)


def pack_rows(df: DataFrame, batch: str, order: str, max_len: int, separator: int, pad: int = 0) -> DataFrame:
    """One row per packed row of a batch, padded to the batch's width.

    `df` has ids (array<long>), prompt_length, source, example_id. Columns: batch, row_no, input_ids, labels, position_ids,
    doc_ids (-1 separator, -2 padding), attention_mask, boundaries.
    """
    df = df.withColumn("__ids", F.slice("ids", 1, max_len)).withColumn("__n", F.size("__ids"))
    places = pack_lengths(df, batch, order, "__n", max_len)
    doc = F.struct(
        "start", "end", F.least("prompt_length", "__n").cast("long").alias("prompt_length"), "source", "example_id", F.col("__ids").alias("ids"),
    )
    rows = df.join(places, [batch, order]).groupBy(batch, "row_no").agg(F.array_sort(F.collect_list(doc)).alias("docs"))

    def joined(one, gap) -> Column:
        """Values of each document, a separator's value before all but the first."""
        return F.flatten(F.transform("docs", lambda d, i: F.when(i == 0, one(d, i)).otherwise(F.concat(F.array(F.lit(gap).cast("long")), one(d, i)))))

    as_long = "array<bigint>"
    rows = rows.withColumns({
        "input_ids": joined(lambda d, i: d["ids"].cast(as_long), separator),
        "labels": joined(lambda d, i: F.transform(d["ids"], lambda x, k: F.when(k < d["prompt_length"], F.lit(IGNORED)).otherwise(x).cast("long")), IGNORED),
        "position_ids": joined(lambda d, i: F.transform(d["ids"], lambda x, k: k.cast("long")), 0),
        "doc_ids": joined(lambda d, i: F.transform(d["ids"], lambda x: i.cast("long")), -1),
    })
    rows = rows.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1).cast("long")))
    width = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    rows = rows.withColumn("__width", width)
    for c, fill in (("labels", IGNORED), ("position_ids", 0), ("doc_ids", -2), ("attention_mask", 0), ("input_ids", pad)):
        rows = rows.withColumn(c, padded(F.col(c), F.col("__width"), fill))
    boundaries = F.transform("docs", lambda d: F.struct(*[d[c].alias(c) for c in ("start", "end", "prompt_length", "source", "example_id")]))
    return rows.select(batch, "row_no", "input_ids", "labels", "position_ids", "doc_ids", "attention_mask", boundaries.alias("boundaries"))


def padded(x: Column, width: Column, fill: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(fill).cast("long"), (width - F.size(x)).cast("int")))


def isolated_mask(doc_ids: Column) -> Column:
    """Square 0/1 mask of a row: a position sees earlier ones of its own document; separators and padding see themselves."""
    return F.transform(doc_ids, lambda d, i: F.transform(doc_ids, lambda e, j: F.when(((d >= 0) & (d == e) & (j <= i)) | ((d < 0) & (i == j)), 1).otherwise(0)))


def visible_positions(doc_ids: Column) -> Column:
    """Number of ones of `isolated_mask`, in one pass without the square; a document's positions stand together, as `pack_rows` puts them."""
    start = F.struct(F.lit(-1).cast("long").alias("doc"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("seen"))

    def step(acc: Column, d: Column) -> Column:
        run = F.when((d >= 0) & (d == acc["doc"]), acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(d.cast("long").alias("doc"), run.alias("run"), (acc["seen"] + run).alias("seen"))

    return F.aggregate(doc_ids, start, step, lambda acc: acc["seen"])


def encode_side(prompt_ids: Column, response_ids: Column, max_len: int) -> Column:
    """struct(input_ids, attention_mask, labels, fault) of a prompt with one answer, cut to max_len."""
    ids = F.slice(F.concat(prompt_ids, response_ids), 1, max_len)
    prompt = F.least(F.size(prompt_ids), F.size(ids))
    # as masked_labels(ids, prompt), but the sizes are found once and not for every position
    labels = F.concat(F.array_repeat(F.lit(IGNORED).cast("long"), prompt), F.slice(ids, prompt + 1, F.size(ids) - prompt).cast("array<bigint>"))
    shifted = F.exists(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != IGNORED)
    fault = F.when(F.size(ids) <= prompt, "no response tokens").when(~shifted, "no shifted response labels")
    return F.struct(ids.cast("array<bigint>").alias("input_ids"), F.transform(ids, lambda x: F.lit(1).cast("long")).alias("attention_mask"), labels.alias("labels"), fault.alias("fault"))


def encode_pairs(df: DataFrame, prompt_ids: Column, chosen_ids: Column, rejected_ids: Column, max_len: int, policy: str = "fail") -> DataFrame:
    """`df` with structs `chosen_side` and `rejected_side`; a side without response labels raises, or under `skip` drops the pair."""
    df = df.withColumns({"chosen_side": encode_side(prompt_ids, chosen_ids, max_len), "rejected_side": encode_side(prompt_ids, rejected_ids, max_len)})
    fault = F.coalesce("chosen_side.fault", "rejected_side.fault")
    if policy == "skip":
        return df.where(fault.isNull())
    return df.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def collate_pairs(df: DataFrame, batch: str, pad: int = 0) -> DataFrame:
    """Both sides of a batch padded to one common width; scores of the reference on some rows of a batch but not on others are an error."""
    group = Window.partitionBy(batch)
    width = F.max(F.greatest(F.size("chosen_side.input_ids"), F.size("rejected_side.input_ids"))).over(group)
    df = df.withColumn("width", width)
    if "ref_chosen_logp" in df.columns:
        known, n = F.count("ref_chosen_logp").over(group), F.count("*").over(group)
        df = df.withColumn("__ok", (known == 0) | (known == n))
        df = df.where(F.when(F.col("__ok"), F.lit(True)).otherwise(F.raise_error(F.lit("a batch has reference scores on some rows only")).cast("boolean"))).drop("__ok")
    for side in ("chosen", "rejected"):
        x = F.col(f"{side}_side")
        df = df.withColumns({f"{side}_input_ids": padded(x["input_ids"], F.col("width"), pad), f"{side}_attention_mask": padded(x["attention_mask"], F.col("width"), 0), f"{side}_labels": padded(x["labels"], F.col("width"), IGNORED)})
    return df


def sequence_logprob(df: DataFrame, seq: str, position: str, logits: str, label: str, policy: str = "fail") -> DataFrame:
    """seq, logp, tokens: masked token log-probabilities summed by sequence; a position's logits are held against the next label.

    Labels of the prompt are IGNORED. A sequence of one position, or without a response label after the first, raises, or
    under `skip` gives no row.
    """
    after = F.lead(label).over(Window.partitionBy(seq).orderBy(position))
    df = df.select(seq, after.alias("__next"), logits).withColumn("__logp", F.when(F.col("__next") != IGNORED, token_logprob(F.col(logits), F.col("__next"))))
    out = df.groupBy(seq).agg(F.sum("__logp").alias("logp"), F.count_if(F.col("__next") != IGNORED).alias("tokens"), F.count("*").alias("__n"))
    if policy == "skip":
        return out.where("tokens > 0").drop("__n")
    fault = F.when(F.col("__n") < 2, "a sequence has two positions at least").when(F.col("tokens") == 0, "no response labels")
    return out.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))).drop("__n")


def parameter_band(name: Column, rank: Column) -> Column:
    """Weight decay spares parameters named `*.bias` and those of one dimension."""
    return F.when(name.endswith(".bias") | (rank == 1), "no_decay").otherwise("decay")
