"""Column functions on text: tokens, overlap, identifiers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no subject (fixed values).
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might can shall "
    "its it that this these those which who what not no nor so if than then also just about into over after before between under within without through during "
    "such both each every all some any more most other new novel using based proposed method approach paper system model results show shown use used present "
    "study demonstrate"
).split()
#: Words of a title that make no search query (fixed values).
TITLE_STOP_WORDS = (
    "the a an and or of in on to for with by at from is are was were be been being this that these those it its based using via new novel approach method system "
    "design control analysis model study towards toward application experimental proposed adaptive active robust improved efficient modified enhanced nonlinear "
    "linear hybrid"
).split()
#: Substrings of a query on computing (fixed values).
COMPUTING = (
    "neural", "network", "learning", "transformer", "attention", "llm", "gpt", "bert", "diffusion", "reinforcement", "gan", "rnn", "cnn", "lstm", "computer vision",
    "nlp", "natural language", "robotics", "optimization", "gradient", "backprop", "convolution", "machine", "deep", "agent", "token", "embedding", "graph", "model",
    "training", "inference", "fine-tun", "generat", "language model", "self-attention", "vision",
)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at either end, line ends too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(f"({pattern})"), 1)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lowered after they are cut out: no other letter turns into one by lowering."""
    return F.transform(_all(text, "[a-zA-Z0-9]+"), F.lower)


def query_tokens(text: Column) -> Column:
    """Tokens in their own case, hyphenated words whole."""
    return _all(text, "[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*")


def token_set(text: Column, least: int = 2) -> Column:
    """Distinct lowered tokens without stop words."""
    words = F.array_except(_all(F.lower(text_or_empty(text)), "[a-z0-9]+"), F.array(*map(F.lit, STOP_WORDS)))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= least)


def word_set(text: Column, least: int = 1) -> Column:
    """Distinct runs of ``[a-z0-9_]`` of at least ``least`` characters, after lowering."""
    return F.array_distinct(_all(F.lower(text_or_empty(text)), f"[a-z0-9_]{{{least},}}"))


def long_words(text: Column, more_than: int = 3) -> Column:
    """Distinct lowered words between white space, punctuation kept."""
    return F.array_distinct(F.transform(F.filter(F.split(F.trim(text_or_empty(text)), r"\s+"), lambda w: F.length(w) > more_than), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def hits(text: Column, words) -> Column:
    """How many of the words are substrings of the text."""
    found = F.lit(0)
    for w in words:
        found = found + F.contains(text, F.lit(w)).cast("int")
    return found


def word_hits(words_of_text: Column, words) -> Column:
    """How many of the words are elements of an array."""
    found = F.lit(0)
    for w in words:
        found = found + F.array_contains(words_of_text, w).cast("int")
    return found


def arxiv_id(raw: Column) -> Column:
    """The id without its version, or null."""
    return F.nullif(F.regexp_extract(text_or_empty(raw), r"([0-9]{4}\.[0-9]{4,5})", 1), F.lit(""))


def doi(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(text_or_empty(raw))), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def year_in(raw: Column) -> Column:
    """The first year of 1900 to 2099 in a text, or 0."""
    return F.coalesce(F.regexp_extract(text_or_empty(raw.cast("string")), r"((?:19|20)\d{2})", 1).try_cast("int"), F.lit(0))


def level_number(label: Column) -> Column:
    """The smallest i of 1 to 6 such that ``Li`` is in the label, else null."""
    out = F.lit(None).cast("int")
    for i in range(6, 0, -1):
        out = F.when(F.contains(F.upper(label), F.lit(f"L{i}")), F.lit(i)).otherwise(out)
    return out


def parent_level(label: Column) -> Column:
    """``L3-x`` to ``L2``; null for level 1, level 0 and labels without a number."""
    n = F.regexp_extract(label, r"^L(\d+)", 1).try_cast("int")
    return F.when(n > 1, F.concat(F.lit("L"), (n - 1).cast("string")))


def slug(query: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def file_name(name: Column) -> Column:
    """A name that any file system takes."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r'[\\/:*?"<>|\x00-\x1f]', "_"), r"\s+", " ")


def has_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit("[\\x{4e00}-\\x{9fff}]"))


def on_computing(text: Column) -> Column:
    return hits(F.lower(text), COMPUTING) > 0


def edge_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("edge::"), a, F.lit("::"), b)


def duration(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def paragraphs(text: Column, most: int = 3000) -> Column:
    """Paragraphs joined into chunks of at most ``most`` characters; a longer paragraph is a chunk of its own."""
    start = F.array().cast("array<string>")

    def add(chunks: Column, part: Column) -> Column:
        last = F.element_at(chunks, -1)
        fits = (F.size(chunks) > 0) & (F.length(last) + F.length(part) + 2 <= most)
        return F.when(fits, F.concat(F.slice(chunks, 1, F.size(chunks) - 1), F.array(F.concat(last, F.lit("\n\n"), part)))).otherwise(F.concat(chunks, F.array(part)))

    return F.aggregate(F.split(text_or_empty(text), "\n\n"), start, add)


def token_estimate(text: Column) -> tuple[Column, Column]:
    """(tokens in, tokens out) that a language model would take, in whole numbers."""
    n = F.floor(F.length(text_or_empty(text)) / 4)
    return n + 150, F.floor(n * 12 / 10)


def unfenced(text: Column) -> Column:
    """Text without the Markdown fence around it."""
    t = stripped(text_or_empty(text))
    return stripped(F.regexp_replace(F.regexp_replace(t, r"^```(?:markdown|md|json)?\s*", ""), r"\s*```$", ""))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced; names without a value stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), text_or_empty(value.cast("string")))
    return out


def search_terms(title: Column) -> Column:
    """The first two telling words of a title cut at 60 characters, else its first word."""
    words = F.split(F.lower(F.substring(title, 1, 60)), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(TITLE_STOP_WORDS))
    return F.when(F.size(kept) > 0, F.concat_ws(" ", F.slice(kept, 1, 2))).otherwise(F.element_at(F.split(F.substring(title, 1, 60), " "), 1))
