"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the extraction rules.
CLAIM_CUES = ["we introduce", "we present", "we propose", "we show", "we demonstrate", "we prove", "we derive", "we find", "we study", "we develop", "results show", "this paper", "the method"]
SHOWN_CUES = ["show", "demonstrate", "prove", "results"]
METHOD_CUES = ["method", "approach", "using", "uses", "via", "based on", "architecture", "algorithm"]
TECHNIQUES = ["transformer", "attention", "sparse attention", "routing", "retrieval gate", "contrastive learning", "variational", "gradient", "loss", "objective", "simulation", "ablation"]
TAG_TERMS = {
    "transformer": "transformers", "attention": "attention", "sparse": "sparse_computation", "routing": "routing", "retrieval": "retrieval", "equation": "formalism",
    "loss": "optimization", "quantum": "quantum_physics", "neural": "neural_networks", "language model": "language_modeling", "thermodynamic": "thermodynamics", "game": "game_theory",
}
BASE_TAGS = ["ingested", "fallback"]
MATH_SYMBOLS = ["=", "∑", "\\sum", "\\int", "≤", ">=", "<=", "->", "→"]
EQUATION = r"([A-Za-z0-9_{}^<>|()\\/\[\]\s.,:+\-*]+=[^.;\n]{2,})"
ABSTRACT = r"(?is)\babstract\b[:\s-]*(.+?)(?:\b(?:introduction|keywords|references)\b|$)"
VERBS = ["ablation", "benchmark", "compare", "evaluate", "implement", "measure", "test", "train"]


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def collapse(x: Column) -> Column:
    """White space runs as one space, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def contains_any(x: Column, needles) -> Column:
    return F.exists(lits(needles), lambda n: F.contains(x, n))


def sentences(x: Column, most: int = 80, low: int = 35, high: int = 500) -> Column:
    """Sentences of 35 to 500 characters, the first 80."""
    parts = F.transform(F.split(collapse(x), r"(?<=[.!?]) "), lambda s: F.btrim(s, F.lit(" \t\n\r;:")))
    return F.slice(F.filter(parts, lambda s: F.length(s).between(low, high)), 1, most)


def claims(found: Column, name: Column, cues=CLAIM_CUES, most: int = 5) -> Column:
    """Claims (statement, confidence) from sentences: those with a cue, else the first three, else a note on the file."""
    cued = F.slice(F.filter(found, lambda s: contains_any(F.lower(s), cues)), 1, most)
    chosen = F.when(F.size(cued) > 0, cued).when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.concat(F.lit("Automated ingest found content in "), name, F.lit("."))))
    return F.transform(chosen, lambda s: F.struct(F.substring(s, 1, 500).alias("statement"), F.when(contains_any(F.lower(s), SHOWN_CUES), "demonstrated").otherwise("hypothesized").alias("confidence")))


def method_name(s: Column) -> Column:
    """Up to six words after the first cue of using, uses, via, based on that words follow, else of the sentence."""
    low, words = F.lower(s), lambda t: F.array_join(F.slice(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9][A-Za-z0-9_-]*"), F.lit(0)), 1, 6), " ")
    after = [F.nullif(F.when(F.locate(cue, low) > 0, words(F.substr(s, F.locate(cue, low) + len(cue)))), F.lit("")) for cue in ("using ", "uses ", "via ", "based on ")]
    return F.coalesce(*after, F.nullif(words(s), F.lit("")), F.lit("fallback extracted method"))


def methods(found: Column, cues=METHOD_CUES, most: int = 4) -> Column:
    cued = F.slice(F.filter(found, lambda s: contains_any(F.lower(s), cues)), 1, most)
    made = F.transform(cued, lambda s: F.struct(method_name(s).alias("name"), F.substring(s, 1, 700).alias("description")))
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.struct(F.lit("automated text parsing").alias("name"), F.lit("Content was extracted from the PDF with fallback parsing.").alias("description"))))


def techniques(x: Column, terms=TECHNIQUES, most: int = 5) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.slice(F.filter(lits(terms), lambda t: F.contains(low, t)), 1, most)


def equation_of(line: Column) -> Column:
    """The expression in a line of up to 240 characters with a mathematical sign; null if there is none of 5 or more."""
    found = F.trim(F.coalesce(F.nullif(F.regexp_extract(line, EQUATION, 1), F.lit("")), line))
    return F.when((F.length(line) <= 240) & contains_any(line, MATH_SYMBOLS) & (F.length(found) >= 5), F.substring(found, 1, 240))


def equations(x: Column, most: int = 8) -> Column:
    """Expressions in the lines and then the sentences of a text."""
    lines = F.transform(F.split(F.coalesce(x, F.lit("")), r"\n"), lambda s: F.trim(s))
    found = F.transform(F.concat(lines, sentences(x, 120)), equation_of)
    return F.slice(F.filter(found, lambda e: e.isNotNull()), 1, most)


def tags(title: Column, x: Column, terms=None, most: int = 12) -> Column:
    """Base tags and those whose term is in the title or the first 6000 characters."""
    terms = TAG_TERMS if terms is None else terms
    low = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(x, F.lit("")), 1, 6000)))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in terms.items()])
    return F.slice(F.array_distinct(F.concat(lits(BASE_TAGS), F.transform(F.filter(pairs, lambda p: F.contains(low, p["k"])), lambda p: p["v"]))), 1, most)


NUMBERED = r"^\d+(?:\.\d+)*+\s+.+"  # the group repeats possessively, which takes a loop and no stack


def is_header(line: Column) -> Column:
    """A numbered line, or a short one in capitals."""
    return F.rlike(line, F.lit(NUMBERED)) | capital_header(line)


def capital_header(line: Column) -> Column:
    return (F.length(line) < 90) & (line == F.upper(line)) & F.rlike(line, F.lit(r"\p{Lu}"))


def header_title(line: Column) -> Column:
    return F.when(F.rlike(line, F.lit(NUMBERED)), line).otherwise(F.initcap(line))


def year(x: Column) -> Column:
    """The first token of four digits from 1900 to 2100 among blank-separated ones."""
    tokens = F.filter(F.split(F.translate(F.coalesce(x, F.lit("")), "\n", " "), " "), lambda t: F.rlike(t, F.lit("^[0-9]{4}$")))
    return F.get(F.filter(F.transform(tokens, lambda t: F.try_to_number(t, F.lit("9999")).cast("int")), lambda y: y.between(1900, 2100)), 0)


def authors(x: Column) -> Column:
    """Names after the first ' - ' of a line among the first 25, if that part has 120 characters at most; four at most."""
    lines = F.filter(F.slice(F.split(F.coalesce(x, F.lit("")), "\n"), 1, 25), lambda s: F.contains(s, F.lit(" - ")))
    tail = F.transform(lines, lambda s: F.substr(s, F.locate(" - ", s) + 3))
    first = F.get(F.filter(tail, lambda s: F.length(s) <= 120), 0)
    names = F.slice(F.filter(F.transform(F.split(first, ","), lambda n: F.trim(n)), lambda n: n != ""), 1, 4)
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("Unknown")))


def abstract(x: Column) -> Column:
    return F.substring(F.trim(F.regexp_extract(F.coalesce(x, F.lit("")), ABSTRACT, 1)), 1, 1800)


def references(x: Column) -> Column:
    """Non-empty lines from the references (else the bibliography) on."""
    low = F.lower(x)
    at = F.when(F.locate("\nreferences", low) > 0, F.locate("\nreferences", low)).when(F.locate("\nbibliography", low) > 0, F.locate("\nbibliography", low))
    return F.coalesce(F.filter(F.transform(F.split(F.substr(x, at + 1), "\n"), lambda s: F.trim(s)), lambda s: s != ""), F.array().cast("array<string>"))


def abstract_like(x: Column) -> Column:
    """The first of the first 60 lines that has over 30 characters and speaks of this paper."""
    ok = lambda s: (F.length(F.trim(s)) > 30) & contains_any(F.lower(s), ["this paper", "we present", "we study"])
    return F.trim(F.get(F.filter(F.slice(F.split(F.coalesce(x, F.lit("")), "\n"), 1, 60), ok), 0))


def normalized(x: Column) -> Column:
    """Lower case, ligatures opened, other signs than a-z and 0-9 as single spaces."""
    low = F.replace(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("œ"), F.lit("oe")), F.lit("ﬁ"), F.lit("fi"))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def title(given: Column, first_section: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.nullif(F.trim(first_section), F.lit("")), F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_", " "))


def paper_id(name: Column, file_name: Column) -> Column:
    """35 letters and digits of the title, and nine digits of the file name's hash."""
    stem = F.coalesce(F.nullif(F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), 1, 35), F.lit("")), F.lit("paper"))
    number = F.conv(F.substring(F.sha1(file_name.cast("binary")), 1, 10), 16, 10).cast("bigint") % 1_000_000_000
    return F.concat(stem, F.lit("_"), F.lpad(number.cast("string"), 9, "0"))


def slug(x: Column, fallback: str = "item") -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.btrim(dashed, F.lit("-")), 1, 70), F.lit("")), F.lit(fallback))


def short_id(x: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, n)


def shorten(x: Column, most: int) -> Column:
    """At most so many characters, cut ones with three points."""
    c = collapse(x)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def truncate_middle(x: Column, most: int = 24_000) -> Column:
    """Head and tail of a long text around a mark."""
    head = most // 2 - 100
    tail = most - head - 13
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("\n...[truncated]...\n"), F.right(x, F.lit(tail))))


def examples(x: Column, most: int = 8) -> Column:
    """Items of (e.g., a, b/c; d) groups."""
    groups = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\(e\.g\.,?\s*([^)]*)\)"), F.lit(1))
    items = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "[,/;]"))), lambda i: F.trim(i))
    return F.slice(F.filter(items, lambda i: i != ""), 1, most)


def connection_stem(cluster_id: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(cluster_id, "^cluster_", ""), "_[0-9]+$", "")


def approach_specific(x: Column) -> Column:
    return (F.length(F.coalesce(x, F.lit(""))) >= 80) & contains_any(F.lower(F.coalesce(x, F.lit(""))), VERBS)


def paper_type(tag_list: Column, has_methods: Column) -> Column:
    text = F.lower(F.array_join(tag_list, " "))
    out = F.when(F.contains(text, F.lit("review")), "review").when(F.contains(text, F.lit("textbook")), "textbook").when(F.contains(text, F.lit("monograph")), "monograph")
    out = out.when(F.contains(text, F.lit("essay")) | F.contains(text, F.lit("philosophy")), "essay").when(F.contains(text, F.lit("lecture")), "lecture_notes")
    return out.when(has_methods, "paper").otherwise("commentary")


def index_papers(line: Column) -> Column:
    """The papers that a line of a notes index names after 'papers:', up to the next bar."""
    return F.filter(F.transform(F.split(F.regexp_extract(line, r"papers:([^|]+)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")


def stamp(when: Column) -> Column:
    """A time as ISO 8601 in UTC with a Z, to the second; the session's time zone is UTC, and the time is given."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
