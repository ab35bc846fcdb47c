"""Comments: nested replies opened to any depth, attribution to the posts that were asked for, and records of one shape.

Raw rows are JSON text of many shapes. What differs between sources is in tables of paths; the steps are
the same for all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions import scores as S
from lodemark.functions.text import here
from lodemark.operators import normalize as N
from lodemark.session import cut

# ---- nested replies ----

#: Levels that one round opens before the rows are written out.
STEP = 4


@dataclass(frozen=True)
class Nesting:
    """Where a shape keeps its replies (``children``), ids, and the post's address (``post``, inherited by replies without one);
    ``parent`` names a field that says a row's parent itself and then wins."""

    children: str
    ids: tuple[str, ...] = ("commentId", "id")
    post: tuple[str, ...] = ("postUrl",)
    parent: str | None = None


#: Fixed names of the two shapes that nest.
NESTINGS = {"instagram": Nesting("replies"), "facebook": Nesting("comments", post=("facebookUrl", "inputUrl"), parent="replyToCommentId")}


def _text(v: str, name: str) -> Column:
    return F.nullif(F.try_variant_get(F.col(v), f"$['{name}']", "string"), F.lit(""))


def flatten_nested(df: DataFrame, raw: str, nesting: Nesting, max_depth: int = 256) -> DataFrame:
    """One row for each object of a tree of replies, with the columns of ``df``.

    ``raw`` becomes the object without its replies (JSON text). Added: ``depth`` (0 for the outer ones),
    ``is_reply``, ``parent_id`` (the id of the nearest object around it that has one, or what the row says
    itself), ``post`` (the row's own address or the one inherited), ``place`` (positions from the outside in).
    Elements of a list that are no objects are left out with all they hold, and so are rows whose raw text
    is no JSON object; replies that are null or no list count as none. Input columns named as the added
    ones are replaced. Trees deeper than ``max_depth`` raise an error, so that nothing is lost unseen.

    Each round opens ``STEP`` levels inside the rows and writes them; only objects that may have more
    replies below are carried on. No shuffle.
    """
    carry = [c for c in df.columns if c not in (raw, "depth", "is_reply", "parent_id", "post", "place", "v_", "up_")]
    own_parent = _text("v_", nesting.parent) if nesting.parent else F.lit(None).cast("string")

    def seen(x: DataFrame) -> DataFrame:
        """Adds what an object inherits and passes on; ``up_`` is the nearest id around it."""
        own_id = F.coalesce(*[_text("v_", k) for k in nesting.ids])
        return x.withColumn("parent_id", F.coalesce(own_parent, "up_")).withColumn("post", F.coalesce(*[_text("v_", k) for k in nesting.post], "post")).withColumn("up_", F.coalesce(own_id, "up_"))

    def below(x: DataFrame) -> DataFrame:
        inner = F.try_variant_get("v_", f"$['{nesting.children}']", "array<variant>")
        inner = F.filter(inner, lambda r: F.schema_of_variant(r).startswith("OBJECT"))
        return x.select(*carry, (F.col("depth") + 1).alias("depth"), "up_", "post", "place", F.posexplode(inner).alias("i_", "v_")).withColumn("place", F.concat("place", F.array("i_"))).drop("i_")

    top = df.select(*carry, F.try_parse_json(raw).alias("v_")).where(F.schema_of_variant("v_").startswith("OBJECT"))
    level = top.select(*carry, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("up_"), F.lit(None).cast("string").alias("post"), F.array().cast("array<int>").alias("place"), "v_")
    bare = F.to_json(F.map_filter(F.try_variant_get("v_", "$", "map<string,variant>"), lambda k, _: k != nesting.children))
    rounds: list[DataFrame] = []
    for first in range(0, max_depth, STEP):
        levels = [seen(level)]
        for _ in range(STEP - 1):
            levels.append(seen(below(levels[-1])))
        for k, x in enumerate(levels):  # the last level's objects may go on
            deeper = F.col("v_") if k == STEP - 1 else F.lit(None).cast("variant")
            levels[k] = x.select(*carry, bare.alias(raw), "depth", (F.col("depth") > 0).alias("is_reply"), "parent_id", "post", "place", "up_", deeper.alias("v_"))
        part = levels[0]
        for x in levels[1:]:
            part = part.unionByName(x)
        rounds.append(cut(part))
        level = below(rounds[-1].where("v_ IS NOT NULL"))
        if level.isEmpty():
            break
    else:
        raise ValueError(f"replies are nested deeper than {max_depth} levels")
    out = rounds[0]
    for x in rounds[1:]:
        out = out.unionByName(x)
    return out.drop("up_", "v_")


# ---- attribution ----

#: Fixed paths, in their order: addresses that name the post themselves, ids to look for among the posts asked for.
LITERAL = {
    "instagram": ("postUrl", "inputUrl"),
    "facebook": ("facebookUrl", "postUrl", "inputUrl"),
    "youtube": ("videoUrl", "pageUrl", "inputUrl", "postUrl"),
}
LOOKUP = {
    "tiktok": ("aweme_id", "awemeId", "videoId"),
    "youtube": ("videoId", "video_id"),
    "x": ("sourceTweetId", "sourceTarget", "conversationId", "inReplyToId", "inReplyToTweetId"),
}
#: Of these sources the first field that has a value is looked for, and no other.
FIRST_ONLY = ("tiktok", "youtube")
TIKTOK_ID, YOUTUBE_ID = r"/video/(\d+)", r"(?:v=|/shorts/|/live/|youtu\.be/|/embed/)([A-Za-z0-9_-]{6,})"


def _path_list(names: tuple[str, ...]) -> list[str]:
    return ["$" + "".join(f"['{p}']" for p in name.split(".")) for name in names]


def by_source(table: dict[str, tuple[str, ...]], source: Column, other: tuple[str, ...] = ()) -> Column:
    """The paths of a source, as an array; ``other`` for one that the table does not have."""
    entries = [x for s, names in table.items() for x in (F.lit(s), F.array(*map(F.lit, _path_list(names))).cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), source), F.array(*map(F.lit, _path_list(other))).cast("array<string>"))


def values_at(v: str, paths: Column) -> Column:
    """What a variant has at ``paths``, trimmed, in their order, without what is null or empty."""
    return F.filter(F.transform(paths, lambda p: F.nullif(F.trim(F.call_function("try_variant_get", F.col(v), p, F.lit("string"))), F.lit(""))), lambda x: x.isNotNull())


def post_key(source: Column, ref: Column) -> Column:
    """What ids are compared with: the video's id in an address of a source of videos, otherwise the reference itself."""
    found = lambda p: F.nullif(F.regexp_extract(ref, p, 1), F.lit(""))
    bare = F.when(~F.contains(ref, F.lit("/")) & ~F.contains(ref, F.lit("?")), F.nullif(F.trim(ref), F.lit("")))
    return F.when(source == "tiktok", found(TIKTOK_ID)).when(source == "youtube", F.coalesce(bare, found(YOUTUBE_ID))).otherwise(ref)


def attribute_parents(df: DataFrame, seeds: DataFrame, key: str = "id", raw: str = "raw") -> DataFrame:
    """(key, parent_post, rule, matches) for each row of ``df`` (key, source, raw as JSON text) against ``seeds`` (source, ref, ord).

    Rules in their order; the first that gives a post wins: an id of the row is that of a seed ("lookup"; of
    several seeds with it the first by ``ord``, and ``matches`` says how many there were), the row names an
    address ("literal"), the source has but one seed ("only"). Otherwise post and rule are null. Keys have to
    be unique. A seed without a usable id is met by no lookup.
    """
    src = F.col("source")
    df = df.select(key, "source", here(F.try_parse_json(raw)).alias("v_"))
    looked = values_at("v_", by_source(LOOKUP, src))
    address = F.get(values_at("v_", F.lit(_path_list(("videoUrl", "pageUrl", "inputUrl", "url")))), F.lit(0))
    looked = F.when(src == "youtube", F.filter(F.concat(looked, F.array(post_key(src, address))), lambda x: x.isNotNull())).otherwise(looked)
    ids = F.when(src.isin(*FIRST_ONLY), F.slice(looked, 1, 1)).otherwise(looked)
    literal = F.get(values_at("v_", by_source(LITERAL, src)), F.lit(0))
    rows = df.select(F.col(key).alias("k_"), src, here(literal).alias("literal"), here(ids).alias("ids"))
    posts = seeds.where("ref IS NOT NULL AND trim(ref) <> ''").select("source", "ref", "ord")
    known = posts.withColumn("id_", post_key(F.col("source"), F.col("ref"))).where("id_ IS NOT NULL").groupBy("source", "id_").agg(F.min_by("ref", "ord").alias("ref"), F.count(F.lit(1)).alias("n"))
    asks = rows.select("k_", "source", F.posexplode("ids").alias("rank", "id_")).where("id_ IS NOT NULL")
    found = asks.join(known, ["source", "id_"]).groupBy("k_").agg(F.min(F.struct("rank", "ref", "n")).alias("f"))
    only = posts.groupBy("source").agg(F.count(F.lit(1)).alias("seeds"), F.min("ref").alias("only")).where("seeds = 1")
    out = rows.join(found, "k_", "left").join(only, "source", "left")
    rule = F.when(F.col("f.ref").isNotNull(), "lookup").when(F.col("literal").isNotNull(), "literal").when(F.col("only").isNotNull(), "only")
    return out.select(F.col("k_").alias(key), F.coalesce("f.ref", "literal", "only").alias("parent_post"), rule.alias("rule"), F.coalesce("f.n", F.lit(0)).cast("long").alias("matches"))


# ---- records ----

_DEFAULT = {
    "text": ("text", "commentText", "content"), "date": ("timestamp", "createdAt", "date"), "author": ("author", "username", "user.name"),
    "id": ("id", "commentId"), "likes": ("likes", "likeCount"), "replies": ("replyCount", "repliesCount"), "shares": (), "url": ("url", "commentUrl"), "parent": (),
}
#: Fixed paths of each field by source; the first that has a value counts.
FIELDS = {
    "x": {
        "text": ("text", "fullText", "tweetText"), "date": ("createdAt", "timestamp", "date"), "author": ("authorUsername", "author.username", "username"), "id": ("id", "tweetId", "restId"),
        "likes": ("likeCount", "likes"), "replies": ("replyCount", "commentsCount"), "shares": ("retweetCount", "repostCount"), "url": ("url", "tweetUrl"), "parent": ("inReplyToId", "inReplyToTweetId"),
    },
    "tiktok": {
        "text": ("text", "commentText"), "date": ("create_time", "createdAt", "createTime", "timestamp"), "author": ("user.unique_id", "user.uniqueId", "user.nickname", "username"), "id": ("cid", "id", "commentId"),
        "likes": ("digg_count", "likeCount", "likesCount"), "replies": ("reply_comment_total", "replyCount", "repliesCount"), "shares": (), "url": ("url", "commentUrl"), "parent": ("reply_id", "parentId"),
    },
    "instagram": {
        "text": ("text", "commentText"), "date": ("timestamp", "createdAt", "created_at"), "author": ("username", "ownerUsername", "owner"), "id": ("commentId", "id"),
        "likes": ("likesCount", "likeCount"), "replies": ("repliesCount", "childCommentCount", "replyCount"), "shares": (), "url": ("commentUrl", "url"), "parent": ("parentCommentId",),
    },
    "facebook": {
        "text": ("commentText", "text", "message"), "date": ("date", "timestamp", "createdAt", "created_at"), "author": ("profileName", "name", "author.name", "authorName", "username"), "id": ("commentId", "id", "legacyId"),
        "likes": ("likesCount", "reactionsCount", "likeCount"), "replies": ("commentsCount", "replyCount", "repliesCount"), "shares": (), "url": ("commentUrl", "url"),
        "parent": ("replyToCommentId", "parentCommentId", "parent_id", "parentComment.commentId"),
    },
    "youtube": {
        "text": ("comment", "text", "commentText", "content"), "date": ("publishedAt", "published_at", "publishDate", "commentedAt", "date", "timestamp", "createdAt", "time"),
        "author": ("author", "authorName", "authorDisplayName", "channelName", "username"), "id": ("commentId", "cid", "id"),
        "likes": ("voteCount", "likeCount", "likes", "votes"), "replies": ("replyCount", "repliesCount", "replies"), "shares": (), "url": ("commentUrl", "url"), "parent": ("replyToCommentId", "parentCommentId", "parentId"),
    },
}


def normalize_comments(df: DataFrame, seeds: DataFrame, context: DataFrame, now: Column, key: str = "key", raw: str = "raw", same: tuple[str, ...] = ()) -> DataFrame:
    """Records of raw comments: one for each source and comment id, the first by ``key``.

    ``df``: key (unique, ordered), source, raw (JSON text) and, from ``flatten_nested``, parent_id (may be
    null). ``seeds`` (source, ref, ord): the posts asked for. ``context`` (source, ref, text, market_score,
    qualified, tier): what is known of them, one row each; it is joined to the finished records, and a post with
    several rows gives a record for each. With ``same``, columns of both ``df`` and ``context``, only context
    that is equal in these counts. Rows without text go, and so does a post that
    comes back among its own replies. A row without an id gets one from source, post, author and text. A
    direct answer to the post has no parent comment. Dates that cannot be read are null, as of ``now``.
    """
    v = df.select(key, *same, "source", F.col("parent_id").alias("nested_parent"), here(F.try_parse_json(raw)).alias("v_"))
    pick = lambda field: F.get(values_at("v_", by_source({s: f[field] for s, f in FIELDS.items()}, F.col("source"), _DEFAULT[field])), F.lit(0))
    fields = {field: here(pick(field)).alias(f"{field}_") for field in _DEFAULT}
    v = v.select(key, *same, "source", "nested_parent", here(F.try_variant_get("v_", "$.threadingDepth", "string")).alias("deep"), *fields.values())
    nested = F.when(F.col("source").isin(*NESTINGS), F.col("nested_parent"))
    known = [*FIELDS]
    rows = v.select(
        key, *same, "source", F.col("text_").alias("text"), F.col("date_").alias("date_raw"), F.col("author_").alias("author"), F.col("id_").alias("own_id"),
        S.safe_count(F.col("likes_")).alias("likes"), S.safe_count(F.col("replies_")).alias("comments"), S.safe_count(F.col("shares_")).alias("shares"), F.col("url_").alias("own_url"),
        F.coalesce(nested, "parent_").alias("parent"), F.when(F.col("source") == "facebook", S.safe_count(F.col("deep"))).alias("deep"),
    ).where("text IS NOT NULL")
    posts = attribute_parents(df, seeds, key, raw).select(key, "parent_post")
    roots = seeds.where("source = 'x'").select("source", F.col("ref").alias("own_id")).distinct()
    rows = rows.join(posts, key).join(roots, ["source", "own_id"], "left_anti")
    parent = F.when((F.col("source") == "x") & (F.col("parent") == F.col("parent_post")), F.lit(None).cast("string")).otherwise(F.col("parent"))
    answered = F.when(F.col("source") == "tiktok", F.col("parent").isNotNull() & (F.col("parent") != "0")).otherwise(F.col("parent").isNotNull() | (F.coalesce("deep", F.lit(0)) > 0))
    layer = F.when(F.col("source") == "x", "reply").when(F.col("source").isin(known) & answered, "reply").otherwise("comment")
    text_or = lambda c: F.coalesce(c, F.lit("None"))  # noqa: E731  as the ids were made so far
    stable = F.coalesce(F.nullif("own_id", F.lit("")), F.substring(F.sha1(F.concat_ws("|", "source", text_or("parent_post"), text_or("author"), "text")), 1, 24))
    answers_known = (F.col("comments") > 0).cast("int")
    out = rows.select(
        key, *same, F.concat(F.lit("comment:"), "source", F.lit(":"), stable).alias("id"), F.col("source").alias("platform"), "text", N.parse_date(F.col("date_raw"), now).alias("date"), "author",
        "likes", "comments", "shares", F.coalesce("own_url", "parent_post").alias("url"), layer.alias("evidence_layer"), "parent_post",
        parent.alias("parent_comment_id"), stable.alias("comment_id"), F.round((1 + answers_known) / 5.0, 4).alias("metric_coverage"),
    )
    rest = [c for c in out.columns if c != "id"]
    out = out.groupBy("id").agg(F.min_by(F.struct(*rest), key).alias("r")).select("id", *[f"r.{c}" for c in rest if c != key])
    about = context.select(
        F.col("source").alias("platform"), F.col("ref").alias("parent_post"), *same, F.nullif(F.trim("text"), F.lit("")).alias("parent_context"),
        F.round(F.greatest(F.coalesce("market_score", F.lit(0.0)), F.lit(0.0)), 4).alias("parent_market_score"), F.coalesce("qualified", F.lit(False)).alias("parent_subject_qualified"), F.nullif("tier", F.lit("")).alias("parent_qualification_tier"),
    )
    out = out.join(about, ["platform", "parent_post", *same], "left").drop(*same)
    return out.fillna({"parent_market_score": 0.0, "parent_subject_qualified": False})

