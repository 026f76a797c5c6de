"""Chat documents: nested messages of text and image parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "You estimate product prices."


def part(kind: str, image: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), image.cast("string").alias("image"), text.cast("string").alias("text"))


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array_compact(F.array(*parts)).alias("parts"))


def messages(text: Column, image: Column, price: Column, training: bool) -> Column:
    """system, user (image part only where there is one) and, for training, the price with two decimals."""
    none = F.lit(None)
    shown = F.when(image.isNotNull(), part("image", image, none))
    made = [message("system", part("text", none, F.lit(SYSTEM))), message("user", shown, part("text", none, text))]
    if training:
        made.append(message("assistant", part("text", none, F.format_string("%.2f", price))))
    return F.array(*made)


def images(chat: Column) -> Column:
    """Paths of all image parts, in order."""
    parts = F.flatten(F.transform(chat, lambda m: m["parts"]))
    return F.transform(F.filter(parts, lambda p: p["type"] == "image"), lambda p: p["image"])


def first_image(chat: Column) -> Column:
    return F.try_element_at(images(chat), F.lit(1))


def messages_with_image(chat: Column) -> Column:
    return F.size(F.filter(chat, lambda m: F.exists(m["parts"], lambda p: p["type"] == "image")))


def prompt(chat: Column) -> Column:
    return F.slice(chat, 1, F.size(chat) - 1)


def target(chat: Column) -> Column:
    """Text of the last message, whatever its role."""
    return F.try_element_at(F.try_element_at(chat, F.lit(-1))["parts"], F.lit(-1))["text"]


def as_union_json(chat: Column) -> Column:
    """JSON with content as plain text where a message has text alone, as a list of parts where it has an image."""
    texts = lambda m: F.to_json(F.struct(m["role"].alias("role"), F.try_element_at(m["parts"], F.lit(1))["text"].alias("content")))
    lists = lambda m: F.to_json(F.struct(m["role"].alias("role"), m["parts"].alias("content")))
    each = F.transform(chat, lambda m: F.when(F.exists(m["parts"], lambda p: p["type"] == "image"), lists(m)).otherwise(texts(m)))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def from_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turns (role, text by turn) from one row a turn; a conversation is bounded by its own turns."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
