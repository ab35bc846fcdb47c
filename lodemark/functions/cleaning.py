"""Rule scores of the cleaning stage as columns over a record and a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions import scores as S
from lodemark.functions import text as T
from lodemark.session import cut


@dataclass(frozen=True)
class Plan:
    """What is researched: names and terms are given in folded form."""

    client: str = ""
    topic: str = ""
    market: str = "greece"
    core_terms: tuple[str, ...] = ()
    context_terms: tuple[str, ...] = ()
    greeklish_variants: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    place_subject: bool = False


#: Word lists of the rules.
MEDIA_HINTS = ("news", "media", "tv", "radio", "press", "times", "daily", "journal", "newspaper", "ειδησεισ", "nea")
SOCIAL = ("x", "tiktok", "instagram", "youtube", "facebook")
PROMO = ("buy", "order", "sale", "discount", "offer", "register", "registration", "book now", "shop", "price", "promo", "sponsored", "αγορα", "παραγγειλε", "προσφορα", "εκπτωση", "εγγραφη", "κρατηση", "τιμη", "διαγωνισμοσ")
SPAM = ("whatsapp", "telegram", "dm me", "click link", "guaranteed win", "100 guaranteed", "free money", "crypto signal", "στειλε dm", "σιγουρο κερδοσ")
REPOST = ("rt @", "repost", "via @", "shared from", "αναδημοσιευση")
MARKET_TERMS = ("greece", "greek", "hellas", "ellada", "ellhn", "ελλαδα", "ελλην", "athens", "athina", "αθηνα", "thessaloniki", "θεσσαλονικη", "opap", "οπαπ")
GREEKLISH = (
    "kai", "sto", "sti", "stin", "apo", "gia", "me", "tin", "ton", "ellada", "ellhn", "athina",
    "thessaloniki", "kerdisa", "kerdise", "kerd", "xthes", "simera", "stoixima", "tzoker", "opap", "tipota",
    "pali", "einai", "eimai", "dhen", "tha", "opws", "kala", "krima", "aplws", "mazi", "xwris", "prepei",
    "mporei", "ekane", "paizw", "paizei", "epaiksa", "lefta", "xrimata", "klhrwsh", "klirosi", "deltio",
    "tyxi", "tuxi", "aurio", "avrio", "twra", "eixa", "exoun", "ela", "pame", "vre", "giati", "poly", "poli",
)
GREEK_WORDS = ("και", "στο", "στη", "στην", "στησ", "απο", "για", "με", "σε", "την", "τον", "το", "τησ", "ελλαδα", "ελλην", "αθηνα", "θεσσαλονικη", "κυπρο", "κερδ")
ANNOUNCEMENT = (
    r"(?iu)τυχερο[ιί] αριθμο[ιί]|κληρωτ[ιί]δα|winning numbers|results for|gewinnzahlen|estrazione|αποτελ[εέ]σματα.{0,60}αριθμο|αριθμο[ιί].{0,60}κερδ[ιί]ζ|κλ[ηή]ρωσ.{0,60}αριθμο|"
    r"αποτελ[εέ]σματα της κλ[ηή]ρωσης|πραγματοποι[ηή]θηκε.{0,40}κλ[ηή]ρωσ|μοιρ[αά]ζ\w*.{0,25}εκατ|κλ[ηή]ρωση.{0,50}τρελα[ιί]νει"
)


def account_type(platform: Column, author: Column, plan: Plan) -> Column:
    a = T.fold(author)
    own = F.lit(False)
    if plan.client:
        own = own | F.contains(a, F.lit(plan.client))
    if len(plan.topic) >= 5:
        own = own | F.contains(a, F.lit(plan.topic))
    hint = F.exists(F.array(*map(F.lit, MEDIA_HINTS)), lambda h: F.contains(a, h))
    return F.when(platform == "news", "media").when((a != "") & own, "brand_owned").when(hint, "media").when(platform.isin(*SOCIAL) & (a != ""), "person_or_creator").otherwise("unknown")


def account_confidence(account: Column, platform: Column) -> Column:
    return F.when(platform == "news", 0.98).when(account == "brand_owned", 0.86).when(account == "media", 0.72).when(account == "person_or_creator", 0.58).otherwise(0.35)


def features(df: DataFrame, column: str = "text", prefix: str = "") -> DataFrame:
    """Adds what the rules read from a text, each computed once: {prefix}raw, folded, words, latin, toks,
    n_tokens, tags, n_letters, n_greek. Every rule takes these columns, never the text's expression."""
    p = prefix
    df = df.withColumn(f"{p}raw", T.here(F.coalesce(F.col(column), F.lit(""))))
    raw = F.col(f"{p}raw")
    df = df.withColumns({f"{p}folded": T.here(T.fold(raw)), f"{p}tags": T.here(T.n_matches(raw, T.HASHTAG)), f"{p}n_letters": T.here(T.n_letters(raw, r"\p{L}")), f"{p}n_greek": T.here(T.n_letters(raw, T.GREEK))})
    folded = F.col(f"{p}folded")
    df = df.withColumns({f"{p}words": T.here(T.words(folded)), f"{p}latin": T.here(T.latin_words(folded)), f"{p}toks": T.here(T.tokens(folded))})
    return df.withColumn(f"{p}n_tokens", T.here(F.size(f"{p}toks")))


def _n(terms: tuple[str, ...], prefix: str = "") -> Column:
    return T.n_hits(F.col(f"{prefix}folded"), F.col(f"{prefix}words"), terms)


def content_class(platform: Column, account: Column) -> Column:
    repost = F.exists(F.array(*map(F.lit, REPOST)), lambda p: F.startswith(F.col("folded"), p))
    many = (F.col("tags") >= 6) & (F.col("tags") > F.greatest(F.lit(2.0), F.col("n_tokens") * 0.28))
    announced = F.regexp_like("raw", F.lit(r"\d")) & F.regexp_like("raw", F.lit(ANNOUNCEMENT))  # the cheap one first
    return (
        F.when(account == "brand_owned", "owned")
        .when((account == "media") | (platform == "news"), "news")
        .when(repost, "repost")
        .when((_n(PROMO) > 0) | many, "promotional")
        .when(announced, "announcement")
        .when(account == "person_or_creator", "organic")
        .otherwise("unknown")
    )


def content_confidence(content: Column) -> Column:
    """How sure the class of a text is."""
    return F.when(content == "owned", 0.92).when(content == "news", 0.93).when(content == "repost", 0.82).when(content == "promotional", 0.72).when(content == "announcement", 0.85).when(content == "organic", 0.62).otherwise(0.4)


def greek_share(prefix: str = "") -> Column:
    return F.col(f"{prefix}n_greek") / F.greatest(F.col(f"{prefix}n_letters"), F.lit(1))


def parent_market(prefix: str = "p_") -> Column:
    """What market signal a comment may inherit from its parent's text."""
    text = T.squeeze(F.col(f"{prefix}raw"))
    latin = T.translit(F.col(f"{prefix}latin"), F.col(f"{prefix}n_greek"))
    return F.when(text == "", 0.0).when(greek_share(prefix) >= 0.08, 0.55).when(_n(MARKET_TERMS, prefix) > 0, 0.45).when(latin > 0, 0.40).otherwise(0.0)


def with_prose(df: DataFrame) -> DataFrame:
    """Adds the text without links, hashtags and domains, folded (``prose``), and its words.

    A text that can have none of these is its own prose, so it is not folded again.
    """
    marked = F.contains("raw", F.lit("#")) | F.contains("raw", F.lit("://")) | F.contains("raw", F.lit("www.")) | F.regexp_like("raw", F.lit(r"\.(?:com|net|org|gr|co|io|eu|za|info|de|it)"))
    df = df.withColumn("marked", T.here(marked))
    plain = F.regexp_replace("raw", r"https?://\S+|\bwww\.\S+|#[A-Za-z0-9_]+", " ")
    plain = T.fold(F.regexp_replace(plain, r"\b[\w-]+\.(?:com|net|org|gr|co|io|eu|za|info|de|it)(?:\.[a-z]{2})?(?:/\S*)?", " "))
    df = df.withColumn("prose", T.here(F.when(F.col("marked"), plain).otherwise(F.col("folded"))))
    return df.withColumn("prose_words", T.here(F.when(F.col("marked"), T.words(F.col("prose"))).otherwise(F.col("words"))))


def market_score(plan: Plan) -> Column:
    """How much a record belongs to the market: script, terms in prose, spellings, place, and for comments the parent.

    Reads the columns of ``features``, ``with_prose`` and ``with_parent``.
    """
    z = F.lit(0.0)
    if plan.market != "greece":
        return F.when(F.contains(F.col("folded"), F.lit(plan.market)) if plan.market else F.lit(False), F.lit(0.9)).otherwise(F.lit(0.55))
    own = {plan.topic, plan.client}
    ratio = greek_share()
    script = F.when(ratio >= 0.08, 0.62).when(ratio > 0, 0.35).otherwise(T.translit(F.col("latin"), F.col("n_greek")))
    n = T.n_hits(F.col("prose"), F.col("prose_words"), tuple(t for t in MARKET_TERMS if t not in own))
    base = script + F.when(n > 0, F.least(F.lit(0.45), 0.18 + 0.09 * n)).otherwise(z)
    inherited = F.when(F.col("parent_market") >= S.RULES["market_review_below"], F.least(F.col("parent_market"), F.lit(0.55)))
    inherited = inherited.when(base < 0.35, F.least(F.col("parent_signal"), F.lit(0.45))).otherwise(z)
    score = base + F.when(F.col("inherits"), inherited).otherwise(z)
    variants = tuple(v for v in plan.greeklish_variants if v not in own)
    score = score + (F.when(_n(variants) > 0, 0.45).otherwise(z) if variants else z)
    score = score + F.when(_n(tuple(t for t in GREEKLISH if t not in own)) >= 2, 0.35).otherwise(z) + F.when(_n(GREEK_WORDS) >= 2, 0.22).otherwise(z)
    place = F.exists(F.array(*map(F.lit, PLACES)), lambda p: F.contains(F.col("place"), p))
    score = score + F.when(place, 0.35).otherwise(z)
    score = F.when((F.col("foreign_ratio") > 0.4) & (ratio < 0.05), F.least(score, F.lit(0.10))).otherwise(score)
    score = F.least(F.lit(1.0), score)
    if not plan.place_subject:
        return score
    return F.when((_n(plan.core_terms) > 0) | (_n(plan.core_terms, "p_") > 0), 1.0).otherwise(score)


def relevance(plan: Plan) -> Column:
    """struct(score, flags) of the lexical relevance; a comment may take its subject from a qualified parent."""
    z = F.lit(0.0)
    rest = tuple(t for t in (*plan.context_terms, *plan.greeklish_variants) if t not in plan.core_terms)
    market, inherits = F.col("market_score"), F.col("inherits")
    n_core, n_ctx, n_bad = F.col("n_core"), F.col("n_context"), _n(plan.exclusions)
    p_core, p_ctx = (F.when(inherits, _n(t, "p_")).otherwise(F.lit(0)) for t in (plan.core_terms, rest))
    qualified = inherits & F.col("parent_qualified")
    from_parent = (n_core == 0) & ((p_core > 0) | qualified)
    lost = (n_core == 0) & (p_core == 0) & ~qualified
    short = (n_core > 0) & F.lit(len(plan.topic.replace(" ", "")) <= 5) & (market < 0.35) & (n_ctx == 0)
    score = (
        F.when(n_core > 0, F.least(F.lit(0.72), 0.58 + 0.07 * (n_core - 1)))
        .when(from_parent, F.least(F.lit(0.42), 0.34 + 0.04 * F.greatest(F.lit(0), p_core - 1)) + F.when(F.col("n_tokens") >= 2, 0.08).otherwise(z))
        .otherwise(z)
        + F.when(n_ctx > 0, F.least(F.lit(0.22), 0.08 + 0.05 * n_ctx)).when((p_ctx > 0) & (p_core > 0), F.least(F.lit(0.10), 0.04 + 0.02 * p_ctx)).otherwise(z)
        + 0.16 * market
        - F.when(n_bad > 0, F.lit(0.55)).otherwise(z)
        - F.when(short, F.lit(0.32)).otherwise(z)
        - F.when(lost, F.lit(0.18)).otherwise(z)
    )
    greek_parent = (inherits & (F.col("parent_market") >= S.RULES["market_review_below"])) | (F.col("parent_signal") > 0)
    flags = F.array_compact(
        F.array(
            F.when(from_parent, "contextual_parent_match"),
            F.when(from_parent & greek_parent, "parent_market_context"),
            F.when(from_parent & (F.col("parent_tier") != "") & ~F.col("parent_tier").isin("direct", "operator"), "provenance_parent_context"),
            F.when(n_bad > 0, "explicit_exclusion_context"),
            F.when(short, "ambiguous_short_entity"),
            F.when(lost, "core_term_missing"),
            F.when(lost & F.lit(bool(plan.core_terms)) & (n_ctx == 0) & (p_ctx == 0), "no_subject_signal"),
        )
    )
    return F.struct(S.clamp(score).alias("score"), flags.alias("flags"))


def spam_score(content: Column) -> Column:
    raw, tags, n_tokens = F.col("raw"), F.col("tags"), F.col("n_tokens")
    n = _n(SPAM)
    add = lambda c, x: F.when(c, x).otherwise(F.lit(0.0))
    score = (
        add(n > 0, F.least(F.lit(0.7), 0.38 + 0.14 * n))
        + add(tags >= 10, F.lit(0.22))
        + add((content == "promotional") & F.regexp_like(raw, F.lit(T.PHONE)), F.lit(0.28))
        + add(T.n_matches(raw, T.URL) >= 3, F.lit(0.2))
        + add((n_tokens <= 3) & (tags >= 5), F.lit(0.18))
    )
    return F.least(F.lit(1.0), score)


def bot_reasons(followers: Column, following: Column, posts: Column, spam: Column, n_tokens: Column) -> Column:
    """Array of (reason, risk) of a record by itself."""
    hit = lambda c, name, x: F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("reason"), F.lit(x).alias("risk")))
    return F.array_compact(
        F.array(
            hit((followers <= 5) & (following >= 1500), "extreme_following_ratio", 0.18),
            hit(posts >= 50000, "extreme_post_volume_metadata", 0.12),
            hit(spam >= 0.6, "strong_spam_signal", 0.24),
            hit((n_tokens <= 2) & (spam > 0.25), "thin_spam_like_content", 0.1),
        )
    )


def bot_risk(reasons: Column) -> Column:
    return F.least(F.lit(1.0), F.aggregate(reasons, F.lit(0.0), lambda s, r: s + r["risk"]))


#: Places that speak for the market.
PLACES = ("greece", "athens", "attica", "thessaloniki", "ελλαδα", "αθηνα")
#: Columns that records may bring beyond ord, id, platform, author and text, and what stands in for them.
OPTIONAL = {
    "layer": "string", "location": "string", "followers": "bigint", "following": "bigint", "posts": "bigint", "impact": "double",
    "parent_text": "string", "parent_qualified": "boolean", "parent_tier": "string", "parent_market": "double",
}


def with_parent(df: DataFrame) -> DataFrame:
    """Adds ``inherits`` (a comment or reply), the parent's features (p_...) and its market signal."""
    child = F.coalesce(F.col("layer"), F.lit("primary")).isin("comment", "reply")
    df = df.withColumn("inherits", child).withColumn("parent_text", F.when(child, F.col("parent_text")))
    df = features(df, "parent_text", "p_")
    df = df.withColumns({"parent_market": F.greatest(F.coalesce("parent_market", F.lit(0.0)), F.lit(0.0)), "parent_tier": F.when(child, F.coalesce("parent_tier", F.lit(""))).otherwise(F.lit("")), "parent_qualified": F.coalesce("parent_qualified", F.lit(False))})
    return df.withColumn("parent_signal", T.here(parent_market()))


def score(records: DataFrame, plan: Plan) -> DataFrame:
    """Adds the row-wise scores to records (ord, id, platform, author, text and any of ``OPTIONAL``).

    No shuffle; what nobody selects is not computed. Null texts count as empty. Of the features only
    those that later steps need stay.
    """
    df = records.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in records.columns])
    df = features(df)
    if "parent_text" in records.columns:
        df = with_parent(df)
    else:
        df = df.withColumns({"inherits": F.lit(False), "p_folded": F.lit(""), "p_words": F.array().cast("array<string>"), "parent_signal": F.lit(0.0), "parent_market": F.lit(0.0), "parent_tier": F.lit(""), "parent_qualified": F.lit(False)})
    if plan.market == "greece":
        df = with_prose(df)
        latin, greek = T.n_letters(F.col("raw"), "[A-Za-z]"), F.when(F.col("n_greek") > 0, T.n_letters(F.col("raw"), r"[Ͱ-Ͽἀ-῿&&\p{L}]")).otherwise(F.lit(0))
        df = df.withColumn("foreign_ratio", T.here((F.col("n_letters") - latin - greek) / F.greatest(F.col("n_letters"), F.lit(1))))
        df = df.withColumn("place", T.fold(F.col("location")) if "location" in records.columns else F.lit(""))
    df = df.withColumn("account_type", T.here(account_type(F.col("platform"), F.col("author"), plan)))
    df = df.withColumn("content_class", T.here(content_class(F.col("platform"), F.col("account_type"))))
    rest = tuple(t for t in (*plan.context_terms, *plan.greeklish_variants) if t not in plan.core_terms)
    df = df.withColumns({"market_score": T.here(market_score(plan)), "n_core": T.here(_n(plan.core_terms)), "n_context": T.here(_n(rest))})
    df = df.withColumn("relevance", T.here(relevance(plan)))
    df = df.withColumn("spam_score", T.here(spam_score(F.col("content_class"))))
    df = df.withColumn("bot_reasons", T.here(bot_reasons(F.col("followers"), F.col("following"), F.col("posts"), F.col("spam_score"), F.col("n_tokens"))))
    df = df.withColumn("bot_risk", bot_risk(F.col("bot_reasons")))
    extra = [c for c in ("impact",) if c not in records.columns]
    return df.select(*records.columns, *extra, "folded", "toks", "n_tokens", "account_type", "content_class", "market_score", "relevance", "spam_score", "bot_reasons", "bot_risk")


def _first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("ord").alias("_o"), F.min_by("who", "ord").alias("_owner"), F.count(F.lit(1)).alias("_n"), F.count_distinct("who").alias("_whos"), F.bool_and("media").alias("_story"))


def duplicate_flags(rows: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(ord, flag, duplicate_of) of rows (ord, who, media, k_text, k_set, n_set) that are no independent evidence.

    In order: the same text by the same author; the same set of at least 18 words by another author,
    among the rows left; near copies ``near`` (id, leader) of an author's earlier texts. Groups are
    keyed by digests and met by partial aggregation; joins on a hot digest are split at run time.
    """
    mine = rows.where("who IS NOT NULL AND k_text IS NOT NULL")
    first = _first_of(mine, ["who", "k_text"]).select("who", "k_text", "_o")
    exact = mine.join(first, ["who", "k_text"]).where("ord > _o").select("ord", F.lit("exact_duplicate").alias("flag"), F.col("_o").alias("duplicate_of"))
    left = rows.where("n_set >= 18").join(exact.select("ord"), "ord", "left_anti")
    owner = _first_of(left, ["k_set"]).select("k_set", "_o", "_owner")
    other = (F.col("ord") > F.col("_o")) & ~F.col("who").eqNullSafe(F.col("_owner"))
    told = left.join(owner, "k_set").where(other).select("ord", F.lit("syndicated_duplicate_content").alias("flag"), F.col("_o").alias("duplicate_of"))
    out = exact.unionByName(told)
    if near is not None:
        rest = near.select(F.col("id").alias("ord"), F.lit("near_duplicate_same_author").alias("flag"), F.col("leader").alias("duplicate_of"))
        out = out.unionByName(rest.join(out.select("ord"), "ord", "left_anti"))
    return out


def shared_texts(rows: DataFrame) -> DataFrame:
    """(ord, cluster, cluster_size, story, reason, risk): texts of at least 24 characters that two or more authors share.

    What media alone share is a story; the rest adds a risk that grows with the cluster.
    """
    long = rows.where("n_chars >= 24 AND k_text IS NOT NULL")
    g = _first_of(long, ["k_text"]).where("_n >= 2 AND _whos >= 2")
    risk = F.least(F.lit(0.64), 0.32 + 0.08 * F.least(F.lit(5), F.col("_n") - 2))
    g = g.select("k_text", F.col("_o").alias("cluster"), F.col("_n").alias("cluster_size"), F.col("_story").alias("story"), F.when(~F.col("_story"), risk).otherwise(F.lit(0.0)).alias("risk"))
    return long.join(g, "k_text").select("ord", "cluster", "cluster_size", "story", "risk")


def repetitive_authors(rows: DataFrame, least: int = 5, similarity: float = 0.86, times: int = 3) -> DataFrame:
    """(who, risk) of authors of at least ``least`` texts, ``times`` of them nearly identical to their first."""
    many = rows.where("who IS NOT NULL").groupBy("who").agg(F.min("ord").alias("_o"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    words = F.array_distinct("toks")
    firsts = many.select("who", F.col("_o").alias("ord")).join(rows.select("who", "ord", "toks"), ["who", "ord"])
    base = cut(firsts.select("who", F.col("ord").alias("_o"), words.alias("_first")))  # its size is known from here on: where it is small, no text's words are shuffled
    near = rows.select("who", "ord", T.here(words).alias("_words")).join(base, "who").where("ord > _o")
    small, large = F.least(F.size("_words"), F.size("_first")), F.greatest(F.size("_words"), F.size("_first"))
    sim = near.select("who", F.when(small < similarity * large - 1e-6, F.lit(False)).otherwise(T.jaccard(F.col("_words"), F.col("_first")) >= similarity).alias("same"))
    return sim.groupBy("who").agg(F.count_if("same").alias("_n")).where(F.col("_n") >= times).select("who", F.lit(0.24).alias("risk"))


def clean(records: DataFrame, plan: Plan, near: DataFrame | None = None, behavior: DataFrame | None = None) -> DataFrame:
    """The cleaning stage: scores of each record, duplicates, shared texts, authors' behaviour, and the decision.

    ``near`` (id, leader) are near copies by one author (``similarity.near_copies``); ``behavior``
    (who, reason, risk) holds further reasons of an author, ``who`` being platform::author. Scores are
    written once to the shared folder without texts; all later steps read these narrow rows. ``ord``
    is unique and orders the records; an empty author is none and has neither copies nor behaviour.
    """
    author = T.fold(F.col("author"))
    df = score(records, plan).withColumn("who", F.when(author != "", F.concat_ws("::", F.col("platform"), author)))
    words = F.array_sort(F.array_distinct("toks"))
    df = df.withColumns({"n_chars": F.length("folded"), "k_text": F.when(F.col("folded") != "", F.sha2("folded", 256)), "n_set": F.size(words), "k_set": F.sha2(F.array_join(words, " "), 256), "media": F.col("account_type") == "media", "length_": F.length("text")})
    df = cut(df.drop("folded", "text", "parent_text"))
    rows = df.select("ord", "who", "media", "k_text", "k_set", "n_set", "n_chars")
    dup = duplicate_flags(rows, near)
    shared = shared_texts(rows)
    of_author = repetitive_authors(df.select("who", "ord", "toks")).select("who", F.lit("repeated_near_identical_author_content").alias("reason"), "risk")
    if behavior is not None:
        of_author = of_author.unionByName(behavior)
    of_author = of_author.groupBy("who").agg(F.collect_set(F.struct("reason", "risk")).alias("_author"))
    df = df.drop("toks").join(dup.select("ord", F.array("flag").alias("_dup"), "duplicate_of"), "ord", "left")
    df = df.join(shared.select("ord", "cluster", "cluster_size", "story", F.col("risk").alias("_shared")), "ord", "left").join(of_author, "who", "left")
    none = F.array().cast("array<struct<reason:string,risk:double>>")
    together = F.when(F.col("_shared") > 0, F.array(F.struct(F.lit("coordinated_near_duplicate_cluster").alias("reason"), F.col("_shared").alias("risk")))).otherwise(none)
    df = df.withColumn("bot_reasons", F.concat("bot_reasons", together, F.coalesce("_author", none)))
    df = df.withColumn("bot_risk", bot_risk(F.col("bot_reasons")))
    status = S.authenticity_status(F.col("bot_risk"), F.size("bot_reasons"))
    df = df.withColumn("authenticity", status)
    marks = F.array_compact(F.array(F.when(F.col("story"), "story_cluster_member"), F.when(~F.col("story"), "coordination_cluster_member"), F.when(F.col("content_class") == "promotional", "promotional_content"), F.when(status == "suspicious", "suspicious_authenticity"), F.when(status == "likely_automated", "likely_automated")))
    df = df.withColumn("flags", F.concat("relevance.flags", F.coalesce("_dup", F.array().cast("array<string>")), marks))
    d = S.clean_decision(F.col("relevance.score"), F.col("market_score"), F.col("spam_score"), F.col("bot_risk"), F.size("bot_reasons"), F.col("flags"), F.col("content_class"), F.coalesce("impact", F.lit(0.0)))
    df = df.withColumn("decision", d)
    organic = (F.col("decision.decision") == "trusted") & (F.col("content_class") == "organic") & (F.col("account_type") == "person_or_creator") & (F.col("authenticity") == "low_risk") & ~F.coalesce(~F.col("story"), F.lit(False))
    sure = S.classification_confidence(F.col("relevance.score"), F.col("market_score"), account_confidence(F.col("account_type"), F.col("platform")), content_confidence(F.col("content_class")), F.col("bot_risk"))
    weight = F.when(F.col("decision.decision") == "excluded", 0.0).otherwise(1.0 / F.coalesce("cluster_size", F.lit(1)))
    df = df.withColumns({"organic_eligible": organic, "confidence": sure, "origin_class": S.origin_class(F.col("account_type"), F.col("content_class")), "independent_voice_weight": weight, "n_chars": F.col("length_")})
    return df.drop("who", "k_text", "k_set", "n_set", "media", "length_", "_dup", "_shared", "_author")
