"""Text functions as columns; ``fold_exact`` is the one Arrow function, for scripts beyond Latin and Greek."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to; stop words that folded tokens can equal.
ACCENTED = "àáâãäåāăąèéêëēėęěìíîïīįòóôõöøōőùúûüūůűųçćčñńňýÿžźżšśřťďľłğάέήίόύώϊϋΐΰς"
PLAIN = "aaaaaaaaaeeeeeeeeiiiiiioooooooouuuuuuuucccnnnyyzzzssrtdllgαεηιουωιυιυσ"
STOPWORDS = (
    "the", "and", "for", "with", "from", "this", "that", "you", "your", "are", "was", "were", "have", "has", "had", "into",
    "και", "για", "στο", "στη", "στην", "τον", "την", "απο", "που", "με", "σε", "μια", "το", "τα",
)
URL = r"https?://\S+|www\.\S+"
HASHTAG = r"#[\wΑ-Ωα-ωΆ-ώ]+"
PHONE = r"(?:\+?\d[\s().-]*){8,}"


def fold(x: Column) -> Column:
    """Lower case without accents and links; letters, digits, # and @ stay, the rest is one space.

    Covers Latin and Greek letters without leaving the JVM.
    """
    y = F.translate(F.lower(F.trim(F.coalesce(x, F.lit("")))), ACCENTED, PLAIN)
    y = F.replace(F.replace(y, F.lit("ß"), F.lit("ss")), F.lit("œ"), F.lit(""))
    y = F.regexp_replace(y, URL, " ")
    # joining what matches is three times as fast as replacing what lies between
    return F.array_join(F.regexp_extract_all(y, F.lit("[a-z0-9α-ω#@]+"), F.lit(0)), " ")


def _fold_series(col: pd.Series) -> pd.Series:
    link, other = re.compile(URL, re.I), re.compile(r"[^a-z0-9α-ω\s#@]+")

    def one(s: str | None) -> str:
        d = unicodedata.normalize("NFKD", (s or "").strip())
        t = "".join(c for c in d if not unicodedata.combining(c)).casefold()
        return " ".join(other.sub(" ", link.sub(" ", t)).split())

    return col.map(one)


def fold_exact(x: Column) -> Column:
    """The same for any script: compatibility decomposition before case folding, so styled letters become plain ones."""

    def run(col: pd.Series) -> pd.Series:
        return _fold_series(col)

    return F.pandas_udf(run, "string")(x)


def tokens(folded: Column) -> Column:
    """Words of a folded text without stop words, in order."""
    found = F.regexp_extract_all(folded, F.lit(r"[a-zα-ω0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def here(x: Column) -> Column:
    """``x``, computed in this projection and nowhere else.

    The optimizer puts expressions into the filters and projections above them, where a text would be
    folded anew for every term. It leaves alone what is not deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, x)


def words(folded: Column) -> Column:
    """The distinct words of a folded text, # and @ being breaks."""
    return F.array_distinct(F.split(F.translate(folded, "#@", "  "), " "))


def n_hits(folded: Column, found: Column, terms: tuple[str, ...]) -> Column:
    """How many of ``terms`` a text has, from its folded form and its ``words``: one lookup for all single words."""
    single = list(dict.fromkeys(t for t in terms if " " not in t))
    out = F.size(F.array_intersect(found, F.array(*map(F.lit, single)))) if single else F.lit(0)
    for t in dict.fromkeys(t for t in terms if " " in t):
        out = out + F.contains(folded, F.lit(t)).cast("int")
    return out


def padded(folded: Column) -> Column:
    """A folded text in which every word stands between single spaces."""
    return F.concat(F.lit(" "), F.translate(folded, "#@", "  "), F.lit(" "))


def has_term(folded: Column, term: str) -> Column:
    """A phrase anywhere, a single word only whole."""
    return F.contains(folded, F.lit(term)) if " " in term else F.contains(padded(folded), F.lit(f" {term} "))


def hits(folded: Column, terms: tuple[str, ...]) -> Column:
    """Those of ``terms`` that a folded text has, in the order given."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(has_term(folded, t), F.lit(t)) for t in terms]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; empty ones give 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def n_matches(x: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(pattern))


def n_letters(x: Column, cls: str) -> Column:
    """Characters of a class such as ``\\p{L}``."""
    y = F.coalesce(x, F.lit(""))
    return F.length(y) - F.length(F.regexp_replace(y, f"{cls}+", ""))


GREEK = r"[Ͱ-Ͽἀ-῿]"


def greek_ratio(x: Column) -> Column:
    return n_letters(x, GREEK) / F.greatest(n_letters(x, r"\p{L}"), F.lit(1))


def foreign_ratio(x: Column) -> Column:
    """Share of letters that are neither a-z nor Greek."""
    other = n_letters(x, r"\p{L}") - n_letters(x, r"[A-Za-z]") - n_letters(x, r"[Ͱ-Ͽἀ-῿&&\p{L}]")
    return other / F.greatest(n_letters(x, r"\p{L}"), F.lit(1))


#: Function words of Greek typed in Latin letters, and words that look like them elsewhere.
MARKERS = (
    "den", "kai", "gia", "einai", "eimai", "eisai", "mou", "sou", "tou", "tis", "ton", "tin", "sto", "stin",
    "ston", "stous", "apo", "pou", "pws", "opws", "auto", "afto", "ayto", "ola", "oli", "oti", "kati",
    "tipota", "tipote", "poly", "polu", "kala", "kalo", "kalha", "thelw", "thelo", "exw", "exei", "eixa",
    "eixe", "kanw", "kanei", "kaneis", "ginetai", "prepei", "mporei", "mporw", "pali", "akoma", "akomi",
    "xwris", "meta", "prin", "twra", "tora", "simera", "aurio", "xthes", "lefta", "aksizei", "aksizoun",
    "axizei", "axizoun", "kainourgia", "kainourgio", "kainourgies", "paidia", "malista", "episis", "etsi",
    "giati", "ligo", "megalo", "mikro", "kalhmera", "kalimera", "kalispera", "efxaristw", "efharisto",
    "parakalw", "sygnwmh", "pame", "kali", "kalh", "tyxi", "tixi", "olous", "oloi", "oles", "evro", "kerdisa",
    "kerdise", "kerdisame", "exasa", "exase", "exasame", "klirosi", "klirwsi", "kliroseis",
)
FALSE_FRIENDS = (
    "the", "and", "you", "for", "with", "this", "that", "have", "not", "was", "der", "die", "und", "ist",
    "nicht", "ein", "una", "que", "por", "para", "nie", "jest", "sie", "tylko", "jedna", "che", "non", "sono",
    "della",
)


def translit_score(x: Column) -> Column:
    """How strongly Latin-script text reads as Greek: two markers at least, and more of them than false friends."""
    return translit(latin_words(fold(x)), n_letters(x, GREEK))


def latin_words(folded: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("[a-z]+"), F.lit(0)))


def translit(latin: Column, n_greek: Column) -> Column:
    """``translit_score`` from the Latin words of a text and its number of Greek letters."""
    n = F.size(F.array_intersect(latin, F.array(*map(F.lit, MARKERS))))
    foreign = F.size(F.array_intersect(latin, F.array(*map(F.lit, FALSE_FRIENDS))))
    score = F.round(0.30 + 0.10 * F.least(F.lit(3), n - 2), 2)
    return F.when((n_greek > 0) | (n < 2) | (foreign >= n), F.lit(0.0)).otherwise(score)


def handle(x: Column) -> Column:
    """Comparable account handle: lower case, the tail of a link, no @ and no spaces."""
    y = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "/+$", "")
    return F.replace(F.regexp_replace(F.regexp_replace(y, "^.*/", ""), "^@+", ""), F.lit(" "), F.lit(""))


#: Greek letters in Latin ones, and marks of outlets' names.
GREEK_FROM, GREEK_TO = "αβγδεζηικλμνξοπρσςτυφωάέήίόύώ", "avgdeziiklmnxoprsstyfoaeiioyo"
GREEK_PAIRS = (("θ", "th"), ("χ", "ch"), ("ψ", "ps"))
MEDIA_SUFFIXES = (".gr", ".com", ".net", "gr_official", "_official")
MEDIA_MARKERS = (
    "news", "ειδησ", "εφημερ", "εφημεριδα", "tvnews", "webtv", "radio", "ραδιο", "tanea", "tovima", "vima", "protothema", "kathimerini", "efsyn", "documento",
    "iefimerida", "newsit", "newsbomb", "newsbeast", "zougla", "parapolitika", "skai", "cnn", "ant1", "star channel", "open tv", "amna",
    "in.gr", "news247", "reader.gr", "cnn greece", "mononews", "capital.gr", "naftemporiki", "ethnos", "real.gr", "libre", "topontiki", "avgi", "rizospastis",
)
MEDIA_EXACT = ("ert", "ana", "ape", "mega", "alpha", "star", "open", "action24", "kontra")


def transliterate(x: Column) -> Column:
    y = x
    for a, b in GREEK_PAIRS:
        y = F.replace(y, F.lit(a), F.lit(b))
    return F.translate(y, GREEK_FROM, GREEK_TO)


def flat_handle(x: Column) -> Column:
    return F.regexp_replace(transliterate(F.lower(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]", "")


def _flat(s: str) -> str:
    for a, b in GREEK_PAIRS:
        s = s.replace(a, b)
    return "".join(c for c in s.translate(str.maketrans(GREEK_FROM, GREEK_TO)) if c.isalnum())


def looks_like_media(author: Column) -> Column:
    """Whether an account name is that of an outlet; short names only count whole or as a clear prefix."""
    h = handle(author)
    flat = flat_handle(h)
    any_of = lambda cs: F.exists(F.array(*cs), lambda b: b)
    rules = [
        any_of([h.endswith(s) for s in MEDIA_SUFFIXES]),
        any_of([F.contains(h, F.lit(m)) for m in MEDIA_MARKERS]),
        flat.isin(*MEDIA_EXACT),
        any_of([flat.startswith(x) & (F.length(flat) <= len(x) + 4) for x in MEDIA_EXACT]),
        any_of([F.contains(flat, F.lit(_flat(m))) for m in MEDIA_MARKERS if len(m) > 4]),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out | rule
    return F.when(h == "", F.lit(False)).otherwise(out)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def head_tail(x: Column, limit: int) -> Column:
    """At most ``limit`` characters: three quarters from the front, one from the end."""
    t = squeeze(x)
    head, tail = limit * 3 // 4, limit // 4
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(head)), F.lit(" … "), F.right(t, F.lit(tail))))


def grounded(quote: Column, text: Column, parent: Column) -> Column:
    """Whether a quote stands in the text or its parent, spaces and case aside."""
    q = F.lower(squeeze(quote))
    return (q != "") & F.contains(F.lower(squeeze(F.concat_ws(" ", text, parent))), q)


def uniq(x: Column) -> Column:
    """First spellings of an array, case aside, in order; empty ones go. By sorting, so long arrays stay cheap."""
    full = F.filter(F.transform(x, lambda t: F.trim(t)), lambda t: t != "")
    keyed = F.array_sort(F.transform(full, lambda t, i: F.struct(F.lower(t).alias("k"), i.alias("i"), t.alias("t"))))
    once = lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"]))
    first = F.get(F.transform(F.array(keyed), once), F.lit(0))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["t"].alias("t")))), lambda e: e["t"])
