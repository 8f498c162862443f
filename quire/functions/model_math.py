"""Sizes, grids, tokens and sampling filters around the models, as column expressions and small DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def raster_size(width: Column, height: Column, dpi: int = 200, cap: int = 3500, whole: str = "ceil") -> Column:
    """[w, h] of a page of so many points at dpi, its long side at most cap; whole: ceil or round."""
    scale = F.least(F.lit(dpi / 72.0), F.lit(float(cap)) / F.greatest(width, height))
    f = F.ceil if whole == "ceil" else F.round
    return F.array(*[F.greatest(F.lit(1), f(x * scale).cast("int")) for x in (width, height)])


def page_cap(option: int | None, default: int | None) -> int | None:
    """The lesser of two caps, or the one there is."""
    caps = [c for c in (option, default) if c is not None]
    if any(c <= 0 for c in caps):
        raise ValueError("a page cap must be positive")
    return min(caps) if caps else None


def smart_resize(t: Column, h: Column, w: Column, factor: int = 28, t_factor: int = 2, least: int = 12_544, most: int = 9_633_792) -> Column:
    """M7: [h, w] in multiples of factor within a budget of pixels; null where the frame count or the aspect is out of bounds.

    Rounding is half away from zero. Sides under the factor are scaled up first, both by one scale.
    """
    f, tf = float(factor), float(t_factor)
    grow = F.when((h < factor) | (w < factor), F.greatest(f / h, f / w)).otherwise(F.lit(1.0))
    hh, ww = F.floor(h * grow), F.floor(w * grow)
    hb, wb, tb = F.round(hh / f) * factor, F.round(ww / f) * factor, F.round(t / tf) * t_factor
    total = tb * hb * wb
    shrink, expand = F.sqrt(t * hh * ww / float(most)), F.sqrt(float(least) / (t * hh * ww))

    def side(x: Column, plain: Column) -> Column:
        smaller = F.greatest(F.lit(factor).cast("double"), F.floor(x / shrink / f) * factor)
        return F.when(total > most, smaller).when(total < least, F.ceil(x * expand / f) * factor).otherwise(plain).cast("int")

    fits = (t >= t_factor) & (F.greatest(hh, ww) / F.least(hh, ww) <= 200)
    return F.when(fits, F.array(side(hh, hb), side(ww, wb)))


def resize_backend(h: Column, w: Column) -> Column:
    """M8: short or very wide images take the other backend."""
    return F.when((h <= 24) | (w >= 8 * h), "vimage").otherwise("lanczos")


def anchors(spark: SparkSession, shapes: Sequence[tuple[int, int]], grid: float = 0.05) -> DataFrame:
    """M5: (level, y, x, cx, cy, wh, valid) of all cells; the values are logits, null where a cell is invalid."""
    rows = spark.createDataFrame([(i, h, w, grid * 2**i) for i, (h, w) in enumerate(shapes)], "level int, gh int, gw int, wh double")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("gh") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("gw") - 1)).alias("x"))
    cx, cy = (F.col("x") + 0.5) / F.col("gw"), (F.col("y") + 0.5) / F.col("gh")
    inside = [(v > 0.01) & (v < 0.99) for v in (cx, cy, F.col("wh"))]
    valid = inside[0] & inside[1] & inside[2]
    return rows.select("level", "y", "x", *[F.when(valid, F.round(F.log(v / (1 - v)), 6)).alias(n) for n, v in (("cx", cx), ("cy", cy), ("wh", F.col("wh")))], valid.alias("valid"))


def mask_box(mask: Column, width: int) -> Column:
    """M6: [cx, cy, w, h] in 0 to 1 of the positive cells of a flat mask; a tiny box in the middle where there are none."""
    at = F.filter(F.transform(mask, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(at, lambda i: i % width), F.transform(at, lambda i: F.floor(i / width))
    height = F.size(mask) / width
    x1, x2 = F.array_min(xs) / width, (F.array_max(xs) + 1) / width
    y1, y2 = F.array_min(ys) / height, (F.array_max(ys) + 1) / height
    return F.when(F.size(at) > 0, F.array((x1 + x2) * 0.5, (y1 + y2) * 0.5, x2 - x1, y2 - y1)).otherwise(F.array(*map(F.lit, (0.5, 0.5, 1e-3, 1e-3))))


def image_tokens(t: Column, h: Column, w: Column, merge: int = 2) -> Column:
    """Tokens of an image of t by h by w patches."""
    return F.greatest(F.lit(1), F.floor(t * h * w / (merge * merge)).cast("int"))


def expand_placeholder(tokens: Column, image: int, n: Column) -> Column:
    """The first image token repeated n times; null where there is none."""
    first = F.array_position(tokens, F.lit(image)).cast("int")
    out = F.concat(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), first - 1)), F.array_repeat(F.lit(image), n), F.slice(tokens, first + 1, F.size(tokens)))
    return F.when(first > 0, out)


def chat_prompt(prompt: Column) -> Column:
    """The prompt in the chat template."""
    return F.concat(F.lit("[gMASK]<sop><|user|>\n<|begin_of_image|><|image|><|end_of_image|>"), prompt, F.lit("<|assistant|>\n"))


def left_pad(tokens: Column, length: Column, pad: int) -> tuple[Column, Column]:
    """Tokens padded on the left, and the mask with 1 for each token."""
    gap = F.greatest(F.lit(0), length - F.size(tokens))
    return F.concat(F.array_repeat(F.lit(pad), gap), tokens), F.concat(F.array_repeat(F.lit(0), gap), F.transform(tokens, lambda x: F.lit(1)))


def repetition_penalty(logit: Column, seen: Column, penalty: float = 1.1) -> Column:
    """Logits of tokens among the last ones divided by the penalty, negative ones multiplied."""
    return F.when(seen, F.when(logit < 0, logit * penalty).otherwise(logit / penalty)).otherwise(logit)


def recently_seen(tokens: Column, token: Column, window: int = 20) -> Column:
    """Whether a token is among the last `window` of the tokens so far."""
    return F.array_contains(F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - window + 1), F.lit(window)), token)


def next_token(scores: DataFrame, keys: Sequence[str], *, temperature: float = 0.8, top_p: float = 0.9, top_k: int = 50, penalty: float = 1.1, window: int = 20, seed: int = 0, token: str = "token", logit: str = "logit", history: str = "history") -> DataFrame:
    """(keys, token) of a step: penalised by its `history`, then the likeliest at temperature 0, else drawn from what the filters leave.

    Equally likely tokens go by number at temperature 0. A draw takes the greatest of log p / temperature plus a Gumbel
    variable made from seed, keys and token, so that a step drawn again gives the same token wherever it runs.
    """
    out = scores.withColumn(logit, repetition_penalty(F.col(logit), recently_seen(F.col(history), F.col(token), window), penalty))
    if temperature == 0:
        best = F.struct(F.col(logit), -F.col(token))
    else:
        out = sampling_filters(out, keys, top_p, top_k, token, logit)
        u = (F.pmod(F.xxhash64(F.lit(seed), *keys, F.col(token)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        best = F.struct((F.log("p") / temperature - F.log(-F.log(u))).alias("s"), -F.col(token))
    return out.groupBy(*keys).agg(F.max_by(token, best).alias(token))


def sampling_filters(scores: DataFrame, keys: Sequence[str], top_p: float = 0.9, top_k: int = 50, token: str = "token", logit: str = "logit") -> DataFrame:
    """Tokens left by the top-p and then the top-k filter, with `p`, their share before the filters.

    Top-p leaves tokens until the shares of those at most as likely add up to more than 1 - top_p,
    counted from the least likely. Ties by token, the greater one last. A step's vocabulary is one
    window partition, sorted once for both filters.
    """
    step = Window.partitionBy(*keys)
    rising = step.orderBy("p", F.desc(token)).rowsBetween(Window.unboundedPreceding, 0)
    falling = step.orderBy(F.desc("p"), F.asc(token))
    out = scores.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(step))).withColumn("p", F.round(F.col("_e") / F.sum("_e").over(step), 12))
    if 0 < top_p < 1:
        out = out.withColumn("_below", F.sum("p").over(rising)).where(F.round("_below", 9) > F.lit(round(1 - top_p, 9)))
    if top_k > 0:
        out = out.withColumn("_rank", F.row_number().over(falling)).where(F.col("_rank") <= top_k)
    return out.drop("_e", "_below", "_rank")


def until_stop(tokens: Column, stops: Sequence[int], cap: int) -> Column:
    """Tokens before the first stop token, at most cap."""
    first = F.array_position(F.transform(tokens, lambda x: x.isin(*stops)), F.lit(True)).cast("int")
    return F.slice(tokens, F.lit(1), F.least(F.lit(cap), F.when(first > 0, first - 1).otherwise(F.size(tokens))))


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each model, the greater name of equally new ones; a link counts as its target."""
    w = Window.partitionBy("model").orderBy(F.desc("mtime"), F.desc("name"))
    real = F.when(F.col("is_symlink"), F.col("target")).otherwise(F.col("name"))
    return snapshots.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("model", real.alias("path"), "mtime")


def integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (path, sha256) against (path, content): 'ok', 'changed' or 'missing'."""
    have = files.select("path", F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("sha256"), "ok").otherwise("changed")
    return manifest.join(have, "path", "left").select("path", state.alias("state"))


def input_signature(jobs: DataFrame) -> DataFrame:
    """Token and grid counts by which two runs' inputs can be told apart."""
    size = smart_resize(F.lit(2), F.col("height"), F.col("width"))
    grid = F.transform(size, lambda x: (x / 14).cast("int"))
    return jobs.select("doc", "page", "idx", grid.alias("grid"), image_tokens(F.lit(1), grid[0], grid[1]).alias("image_tokens"), F.char_length(chat_prompt(F.col("prompt"))).alias("prompt_chars"))
