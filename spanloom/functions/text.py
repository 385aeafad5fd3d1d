"""Text functions as column expressions: cleaning, splitting, escaping, splicing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u4e00-\\u9fff]"
MARKER = "^#[0-5]#$"
SPECIAL_BUILD = "[@+/|:\"]"
SPECIAL_QUERY = "[@+/]"
_CUT = "\u0001"


def repo_key(url: Column) -> Column:
    """owner#repo from the last two parts of a URL; a trailing slash leaves the repository part empty; null for null."""
    p = F.split(url, "/")
    return F.concat(F.coalesce(F.try_element_at(p, F.lit(-2)), F.lit("")), F.lit("#"), F.element_at(p, -1))


def repo_key_any(url: Column) -> Column:
    """owner#repo of the several spellings of one address: scheme, case, .git and trailing slashes do not matter."""
    u = F.regexp_replace(F.trim(url), r"(\.git)?/*$", "")
    return F.lower(F.concat(F.regexp_extract(u, r"([^/:]+)/[^/]+$", 1), F.lit("#"), F.regexp_extract(u, r"([^/]+)$", 1)))


def clean_markdown(t: Column) -> Column:
    """Blank text, fenced code, badges, images and link targets removed, in this order; a link leaves its caption."""
    t = F.regexp_replace(t, r"\A\s*\n\z", "")
    t = F.regexp_replace(t, r"```[\s\S]*?```", "")
    t = F.regexp_replace(t, r"\[!\[[^\n]*?\]\([^\n]*?\)\]\([^\n]*?\)", "")
    t = F.regexp_replace(t, r"!\[[^\n]*?\]\([^\n]*?\)", "")
    return F.regexp_replace(t, r"\[([^\n]*?)\]\([^\n]*?\)", "$1")


def has_cjk(t: Column) -> Column:
    return t.rlike(CJK)


def tokens(t: Column) -> Column:
    """White-space tokens, empty ones dropped."""
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def enough_tokens(toks: Column, least: int = 3) -> Column:
    """At least `least` tokens besides category markers."""
    return F.size(F.filter(toks, lambda x: ~x.rlike(MARKER))) >= least


def drop_rules(toks: Column) -> Column:
    """Tokens without // and --- inside."""
    return F.filter(toks, lambda x: ~x.contains("//") & ~x.contains("---"))


def split_special(t: Column, special: str = SPECIAL_BUILD) -> Column:
    """Split before and after each special character and keep it; no empty parts; a text without any is one part."""
    return F.filter(F.split(F.regexp_replace(t, f"({special})", f"{_CUT}$1{_CUT}"), _CUT + "+"), lambda x: x != "")


def split_name(name: Column) -> Column:
    return F.split(name, "-|_")


def escape_blanks(t: Column) -> Column:
    return F.replace(t, F.lit(" "), F.lit("%"))


def unescape_blanks(t: Column) -> Column:
    """The inverse of escape_blanks, for texts that had no %."""
    return F.replace(t, F.lit("%"), F.lit(" "))


def pad_parentheses(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\(", " ( "), r"\)", " ) ")


def splice_entity(toks: Column) -> Column:
    """Tokens joined by blanks, then no blanks around - / . ( ) @."""
    return F.regexp_replace(F.array_join(toks, " "), r" ?([-/.()@]) ?", "$1")


def clean_marker(t: Column) -> Column:
    """Remove #[1]#, then #1#, then [1]."""
    for p in (r"#\[\d+\]#", r"#\d+#", r"\[\d+\]"):
        t = F.regexp_replace(t, p, "")
    return t


def lemma(word: Column) -> Column:
    """A rule lemma: lower case, plural endings off. Pluggable: any Column -> Column function may stand in for it."""
    w = F.lower(word)
    return (
        F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(ss|us|is)$"), w)
        .when(w.rlike("(x|ch|sh|ss)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[a-z0-9]s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def lemma_key(entity: Column) -> Column:
    """Lemmas of the blank-separated parts, joined again; ' - ' and ' _ ' become one blank."""
    return F.regexp_replace(F.array_join(F.transform(F.split(entity, " "), lemma), " "), " [-_] ", " ")


def node_type(name: Column) -> Column:
    """The kind of a prefixed node name."""
    out = F.when(name.startswith("$LIB"), "library").when(name.startswith("$TOPIC"), "topic").when(name.startswith("$USER"), "user").when(name.startswith("$KEYWORD"), "keyword")
    return out.when(name.startswith("$NE"), F.concat(F.lit("entity"), F.substring(name, 4, 1))).otherwise("other")


def node_name(name: Column) -> Column:
    """The name without its prefix; entities carry one more character."""
    return F.regexp_replace(name, r"^\$(LIB|TOPIC|USER|KEYWORD|NE\d)", "")


# The marks that are tokens of their own.
REFINE_MARKS = r"(-|\.|/|:|\(|\)|,|&|!|=|'|\?|\[|\]|\\|>|（|）|#[0-9]#)"


def refine_tokens(c: Column) -> Column:
    """The tokens between white space, cut around each mark; the empty parts between two marks are left out (FN8)."""
    marked = F.regexp_replace(c, REFINE_MARKS, "\x01$1\x01")
    return F.filter(F.split(marked, "[\x01\\s]+"), lambda x: x != "")
