"""License scans: base phrases, and an exact containment join of text blocks with license templates."""

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, spare_names, text_or_empty, without

#: Between words: every ASCII character but digits and lower-case letters.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    """``marks`` tell a template from its siblings: of each group at least one phrase must stand in a block."""

    label: str
    text: str
    marks: tuple[tuple[str, ...], ...] = ()


GPL = ("gnu general public license",)

#: Customary wordings of license notices, lower-case words as the scanner sees them.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", (("apache",), ("version 2", "license 2", "v 2"))),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", (GPL, ("version 3", "license 3", "v 3", "or 3", "and 3"))),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", (GPL, ("version 2", "versions 2", "license 2", "v 2"))),
    Template("cc-by-nc", "licensed under cc by nc 4 0", (("by nc",),)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", (("by sa",),)),
    Template("mit", "released under the mit license", (("mit license", "mit licence", "the mit"),)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files",
        (("associated",),),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license",
        (GPL,),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        (tuple(f"attribution {w}" for w in ("1", "2", "3", "4", "international", "license")),),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        (("mozilla",), ("v 2", "version 2", "license 2")),
    ),
)

#: Words that turn a notice into its opposite where they part two words that follow each other in a template.
NEGATIONS = ("not", "never", "no")

#: Share of a template's neighbouring words that must be neighbours in a block too.
IN_ORDER = 0.6

OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def neighbours(template: Template) -> list[str]:
    """Pairs of words that follow each other in a template, as phrases between spaces."""
    words = template.text.split()
    return list(dict.fromkeys(f" {a} {b} " for a, b in zip(words, words[1:], strict=False)))


def denials(template: Template) -> list[str]:
    """Phrases that deny a template: a negation before its first word, or between two neighbours."""
    words = template.text.split()
    found = [f" {n} {words[0]} " for n in NEGATIONS]
    return found + [f" {a} {n} {b} " for a, b in zip(words, words[1:], strict=False) for n in NEGATIONS]


def spaced(text: Column) -> Column:
    """The words with a space of their own on either side: ``" a  b  c "``; without words two spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), WORD_GAP, "  ")), F.lit(" "))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), WORD_GAP), lambda w: w != "")


def _places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Count, smallest and largest start of a phrase in spaced words. No phrase overlaps itself."""
    needle = " " + "  ".join(phrase.split(" ")) + " "
    count = ((F.length(words) - F.length(F.replace(words, F.lit(needle), F.lit("")))) / len(needle)).cast("long")

    def words_before(place: Column) -> Column:
        head = F.substring(words, F.lit(1), place - 1)
        return ((F.length(head) - F.length(F.replace(head, F.lit("  "), F.lit(" ")))) + F.when(place > 1, 1).otherwise(0)).cast("long")

    first = F.when(count > 0, words_before(F.instr(words, needle)))
    from_end = F.instr(F.reverse(words), needle[::-1])
    last = F.when(count > 0, words_before(F.length(words) - from_end - len(needle) + 2))
    return count, first, last


def token_order(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> list[str]:
    """The vocabulary by rising number of documents that hold a token, over all documents.

    Only template tokens are counted, so what reaches the driver is bounded by the template list.
    """
    known = F.array(*[F.lit(t) for t in vocabulary])
    held = docs.select(F.explode(F.array_intersect(known, words_of(text_or_empty(text_col)))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def containment_join(blocks: DataFrame, templates: Sequence[Template], order: Sequence[str], threshold: float, in_order: float = 0.0) -> DataFrame:
    """All (block, template) with ``|block & template| >= threshold * |template|``, tokens as sets, and the marks.

    ``blocks`` has ``key`` and ``tokens``. Tokens of a block outside the templates cannot count and are
    left out at once; the rest stand in the global order, rarest first. A template that keeps ``need``
    tokens must share one of its first ``size - need + 1``, so only these are joined on. The length
    filter asks for ``need`` tokens in the block; the positional filter asks for enough tokens behind
    the shared one on both sides. What is left is verified on the whole sets. Siblings share most tokens
    at any threshold, so each also needs its own marks, as phrases in the words of the block. A set says
    nothing of order: ``in_order`` is the share of the template's neighbouring words that must be neighbours
    in the block, and a block that denies the template (``denials``) does not count.
    """
    place = {token: i for i, token in enumerate(order)}
    index = []
    for number, template in enumerate(templates):
        tokens = sorted(set(template.text.split()), key=place.__getitem__)
        need = ceil(threshold * len(tokens) - 1e-9)
        for position, token in enumerate(tokens[: len(tokens) - need + 1]):
            marks = [[f" {phrase} " for phrase in group] for group in template.marks]
            index.append((token, position, number, template.label, tokens, need, marks, neighbours(template), denials(template)))
    schema = (
        "token string, t_place int, template int, label string, t_tokens array<string>, need int, "
        "marks array<array<string>>, pairs array<string>, denied array<string>"
    )
    prefixes = F.broadcast(blocks.sparkSession.createDataFrame(index, schema))  # as many rows as template tokens
    least = min(row[5] for row in index)
    known = F.array_intersect(F.array(*[F.lit(t) for t in order]), F.col("tokens"))
    read = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    ordered = blocks.select("key", known.alias("tokens"), read.alias("block")).filter(F.size("tokens") >= least)
    heads = ordered.select("key", "tokens", "block", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)).alias("b_place", "token"))
    behind = F.least(F.size("t_tokens") - F.col("t_place"), F.size("tokens") - F.col("b_place"))
    candidates = heads.join(prefixes, "token").filter((F.size("tokens") >= F.col("need")) & (behind >= F.col("need")))
    shared = F.size(F.array_intersect("t_tokens", "tokens"))
    marked = F.forall("marks", lambda group: F.exists(group, lambda phrase: F.contains("block", phrase)))
    together = F.size(F.filter("pairs", lambda pair: F.contains("block", pair))) >= F.lit(in_order) * F.size("pairs") - 1e-9
    meant = ~F.exists("denied", lambda phrase: F.contains("block", phrase))
    return candidates.filter((shared >= F.col("need")) & marked & together & meant).select("key", "template", "label", (shared / F.size("t_tokens")).alias("containment"))


def may_hold(text: Column, templates: Sequence[Template], threshold: float) -> Column:
    """Whether the text as a whole has the tokens that one of the templates needs; a block of it has no others."""
    vocabulary = sorted({t for x in templates for t in x.text.split()})
    held = F.array_intersect(F.array(*[F.lit(t) for t in vocabulary]), words_of(text))
    sets = [sorted(set(x.text.split())) for x in templates]
    needs = F.array(*[F.struct(F.array(*[F.lit(t) for t in s]).alias("tokens"), F.lit(ceil(threshold * len(s) - 1e-9)).alias("need")) for s in sets])
    least = min(ceil(threshold * len(s) - 1e-9) for s in sets)
    enough = F.filter(F.array(held), lambda h: F.size(h) >= least)
    return F.exists(enough, lambda h: F.exists(needs, lambda t: F.size(F.array_intersect(t["tokens"], h)) >= t["need"]))


def text_blocks(texts: DataFrame, longest: int) -> DataFrame:
    """(key, tokens) of windows over the words of every text, whatever its lines.

    Windows have ``2 * longest`` words and start every ``longest`` words, so each run of up to ``longest``
    words lies whole in one of them, and no block is longer, however long the text or a line.
    """
    read = texts.select("key", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - longest, F.lit(1)), F.lit(longest))
    return read.select("key", F.explode(F.transform(starts, lambda at: F.slice("words", at, 2 * longest))).alias("tokens"))


def license_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with counts and places of the base phrases, labels and a score.

    Text blocks are windows of the words, across line ends, since notices are wrapped (see ``text_blocks``).
    ``labels`` has the base labels and those of templates contained in a block in their order;
    ``score`` is 1 for a base phrase, else the largest containment, else 0. Null and empty texts have no
    words, no places (null) and empty labels. Repeated rows get the same result each. Input columns named
    like an output are replaced.
    """
    docs = without(docs, OUTPUT)
    key, words = spare_names(docs, "row_key", "spaced_words")
    text = text_or_empty(text_col)
    identity = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))

    vocabulary = sorted({t for x in templates for t in x.text.split()})
    order = token_order(docs, vocabulary, text_col)
    texts = docs.select(identity.alias("key"), text.alias("text"))
    blocks = text_blocks(texts.filter(may_hold(F.col("text"), templates, threshold)), max(len(x.text.split()) for x in templates))
    found = containment_join(blocks, templates, order, threshold, IN_ORDER)
    found = found.groupBy("key").agg(F.collect_set("label").alias("found_labels"), F.max("containment").alias("containment"))
    found = found.select(F.col("key").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in ("found_labels", "containment")])

    read = docs.withColumns({words: spaced(text), key: identity})
    places = [_places(F.col(words), phrase) for phrase, _ in PHRASES]
    labels = F.array_sort(F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for (c, _, _), (_, label) in zip(places, PHRASES, strict=True)])))
    base = read.withColumns(
        {
            "n_words": F.when(F.trim(words) == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit("  "), F.lit(" "))) + 1).cast("long"),
            "n_base": sum((c for c, _, _ in places[1:]), places[0][0]),
            "first_word": F.least(*[f for _, f, _ in places]),
            "last_word": F.greatest(*[x for _, _, x in places]),
            "base_labels": F.array_join(labels, ","),
        }
    ).drop(words)
    joined = base.join(found, base[key].eqNullSafe(found[key]), "left").drop(found[key])
    more = F.coalesce(F.col(f"{key}_found_labels"), F.array().cast("array<string>"))
    base_list = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return joined.withColumns(
        {
            "labels": F.array_join(F.array_sort(F.array_union(base_list, more)), ","),
            "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col(f"{key}_containment"), F.lit(0.0))),
        }
    ).select(*docs.columns, *OUTPUT)
