"""Markdown documents with frontmatter, as column expressions: parsing, normalizing, writing, wrapping thoughts.

A document is ``struct<id, title, description, body, doc_type, tags array<string>, source_path, metadata map>``. A null
content gives a null document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Frontmatter keys that become fields; all others are metadata.
FIELDS = ("title", "type", "tags", "description", "summary")


def unquote(v) -> Column:
    """Trimmed, without one pair of equal quotes around it."""
    t = T.trim(v)
    return F.when(F.rlike(t, F.lit(r"""^(?:"[\s\S]*"|'[\s\S]*')$""")) & (F.length(t) >= 2), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def parse_list(v) -> Column:
    """Items of ``[a, b]``, null for what is no list."""
    t = T.trim(v)
    items = F.filter(F.transform(F.split(F.substr(t, F.lit(2), F.length(t) - 2), ",", -1), unquote), lambda s: s != "")
    return F.when(F.rlike(t, F.lit(r"^\[[\s\S]*\]$")), items)


def frontmatter(content) -> Column:
    """``struct(body, keys, values)``: the last value of each key, keys in order. Without a closed block all is body."""
    t = F.regexp_replace(content, "^﻿+", "")
    rest = F.substr(t, F.lit(4), F.length(t))
    close = F.instr(rest, "\n---")
    fenced = F.startswith(t, F.lit("---")) & (close > 0)
    after = F.substr(rest, close + 4, F.length(rest))
    body = F.when(F.rlike(after, F.lit(r"^\r?\n")), F.regexp_replace(after, r"^\r?\n", "")).otherwise("")
    lines = F.transform(F.split(F.substr(rest, F.lit(1), F.greatest(close - 1, F.lit(0))), "\n", -1), T.trim)
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":")) & ~F.startswith(x, F.lit("#"))), lambda x: F.struct(T.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), unquote(F.regexp_extract(x, r"^[^:]*:([\s\S]*)$", 1)).alias("v")))
    none = F.array().cast("array<string>")

    def result(pairs):
        keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
        values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
        return F.struct(F.when(fenced, body).otherwise(content).alias("body"), F.when(fenced, keys).otherwise(none).alias("keys"), F.when(fenced, values).otherwise(none).alias("values"))

    return F.when(content.isNotNull(), T.let(pairs, result))


def lookup(fm, key: str) -> Column:
    at = F.array_position(fm["keys"], key).cast("int")
    return F.when(at > 0, F.get(fm["values"], at - 1))


def filled(c) -> Column:
    return F.when(c != "", c)


def document(fm, path, concept_id=None, title=None, description=None, extra_tags=None, default_type: str = "document") -> Column:
    """The normalized document of parsed frontmatter: explicit columns first, then frontmatter, then the file's name."""
    null = F.lit(None).cast("string")
    given = lambda c: null if c is None else c
    stem = T.stem(path)
    explicit = F.array().cast("array<string>") if extra_tags is None else extra_tags
    listed = F.coalesce(parse_list(lookup(fm, "tags")), F.array().cast("array<string>"))
    rest = F.filter(fm["keys"], lambda k: ~k.isin(*FIELDS))
    return F.struct(
        F.coalesce(given(concept_id), T.slug(stem)).alias("id"),
        F.coalesce(filled(F.coalesce(given(title), lookup(fm, "title"))), stem).alias("title"),
        F.coalesce(filled(F.coalesce(given(description), lookup(fm, "description"))), lookup(fm, "summary"), F.lit("")).alias("description"),
        fm["body"].alias("body"),
        F.coalesce(filled(lookup(fm, "type")), F.lit(default_type)).alias("doc_type"),
        # explicit tags stay as they are; those listed come once each
        F.concat(explicit, F.array_except(listed, explicit)).alias("tags"),
        path.alias("source_path"),
        F.map_from_arrays(rest, F.transform(rest, lambda k: F.get(fm["values"], (F.array_position(fm["keys"], k) - 1).cast("int")))).alias("metadata"),
    )


def quoted(c) -> Column:
    """In double quotes, with backslashes before quotes, backslashes and the names of line ends and tabs."""
    out = c
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def to_markdown(doc) -> Column:
    """A document as frontmatter and body; metadata in order of their keys."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    keys = F.array_sort(F.map_keys(doc["metadata"]))
    head = F.array(
        line("title", quoted(doc["title"])),
        line("type", doc["doc_type"]),
        F.when(F.size(doc["tags"]) > 0, line("tags", F.concat(F.lit("["), F.array_join(doc["tags"], ", "), F.lit("]")))),
        F.when(doc["description"] != "", line("description", quoted(doc["description"]))),
    )
    lines = F.concat(F.array_compact(head), F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.element_at(doc["metadata"], k))))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("---\n\n"), doc["body"])


def wrapped_thought(thoughts, topic, created, tag: str | Column = "000000", concept_id=None, extra_tags=None) -> Column:
    """Reasoning as a document of its own. ``created`` (a timestamp) and ``tag`` (six characters) are parameters, so
    that the result is determined by its inputs; pass ``F.current_timestamp()`` and a slice of ``F.uuid()`` for new ones.
    """
    tag = F.lit(tag) if isinstance(tag, str) else tag
    short = F.substring(T.slug(topic), 1, 30)
    made = F.concat(F.lit("thought_"), F.when(short == "", "topic").otherwise(short), F.lit("_"), F.date_format(created, "yyyyMMddHHmmss"), F.lit("_"), tag)
    lines = F.array(
        F.lit("---"),
        F.concat(F.lit('title: "Thought: '), topic, F.lit('"')),
        F.lit("type: thought"),
        F.lit("thought_type: reasoning"),
        F.concat(F.lit("topic: "), topic),
        F.concat(F.lit("tags: [thought, reasoning, "), topic, F.lit("]")),
        F.concat(F.lit("created: "), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")),
        F.lit("---"),
        F.lit(""),
        thoughts,
    )
    own = F.array(F.lit("thought"), F.lit("reasoning"), topic)
    more = F.array().cast("array<string>") if extra_tags is None else extra_tags
    return F.struct(
        (made if concept_id is None else F.coalesce(concept_id, made)).alias("id"),
        F.concat(F.lit("Thought: "), topic).alias("title"),
        F.concat(F.lit("Reasoning about "), topic).alias("description"),
        F.array_join(lines, "\n").alias("body"),
        F.lit("thought").alias("doc_type"),
        F.concat(own, F.array_except(more, own)).alias("tags"),
        F.lit(None).cast("string").alias("source_path"),
        F.create_map(F.lit("thought_type"), F.lit("reasoning"), F.lit("topic"), topic).alias("metadata"),
    )
