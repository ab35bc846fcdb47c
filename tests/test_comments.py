"""Nested replies against a plain walk, attribution rules one by one, records of odd rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodemark.operators import comments as C

NOW = "2024-02-01 00:00:00"


def tree(r, depth, children):
    node = {"n": r.randint(0, 9)}
    if r.random() < 0.7:
        node["commentId"] = f"c{r.randint(0, 99)}"
    elif r.random() < 0.5:
        node["id"] = r.randint(100, 199)
    if r.random() < 0.3:
        node[r.choice(["postUrl", "facebookUrl", "inputUrl"])] = f"p{r.randint(0, 9)}"
    if r.random() < 0.2:
        node["replyToCommentId"] = "own"
    kind = r.random()
    if depth and kind < 0.75:
        node[children] = [r.choice([None, "gone", 3, []]) if r.random() < 0.2 else tree(r, depth - 1, children) for _ in range(r.randint(0, 3))]
    elif kind < 0.9:
        node[children] = r.choice([None, [], "none", 5, {}])
    return node


def plain(raw, nesting):
    def walk(node, depth, up, post, place):
        own = next((str(node[k]) for k in nesting.ids if node.get(k) not in (None, "")), None)
        said = node.get(nesting.parent) if nesting.parent else None
        post = next((node[k] for k in nesting.post if node.get(k)), post)
        yield depth, depth > 0, said or up, post, tuple(place), json.dumps({k: v for k, v in node.items() if k != nesting.children}, sort_keys=True)
        inner = node.get(nesting.children)
        for i, x in enumerate([x for x in inner if isinstance(x, dict)] if isinstance(inner, list) else []):
            yield from walk(x, depth + 1, own or up, post, [*place, i])

    return list(walk(raw, 0, None, None, [])) if isinstance(raw, dict) else []


@pytest.mark.parametrize("source", list(C.NESTINGS))
def test_nested_replies(spark, source):
    nesting = C.NESTINGS[source]
    r = random.Random(4)
    raws = [json.dumps(tree(r, 9, nesting.children)) for _ in range(60)] + ["[1]", "{bad", "", None, "{}", '"x"']
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(raws)], "k int, raw string, depth string")
    got = [(x["k"], x["depth"], x["is_reply"], x["parent_id"], x["post"], tuple(x["place"]), json.dumps(json.loads(x["raw"]), sort_keys=True)) for x in C.flatten_nested(df, "raw", nesting).collect()]
    want = [(i, *row) for i, x in enumerate(raws) if i < 60 or x == "{}" for row in plain(json.loads(x), nesting)]
    assert sorted(map(str, got)) == sorted(map(str, want)) and max(x[1] for x in got) > 5


def test_nested_too_deep_is_an_error(spark):
    raw = '{"id":0}'
    for i in range(1, 21):
        raw = f'{{"id":{i},"replies":[{raw}]}}'
    df = spark.createDataFrame([(raw,)], "raw string")
    assert C.flatten_nested(df, "raw", C.NESTINGS["instagram"]).count() == 21
    with pytest.raises(ValueError, match="deeper"):
        C.flatten_nested(df, "raw", C.NESTINGS["instagram"], max_depth=8)
    assert C.flatten_nested(df.limit(0), "raw", C.NESTINGS["instagram"]).count() == 0


SEEDS = [("x", "10", 1), ("x", "20", 2), ("tiktok", "https://t/@a/video/77", 1), ("tiktok", "https://t/@b/video/77?x", 2), ("tiktok", "https://t/@c/video/78", 3), ("youtube", "https://youtu.be/abcdef1", 1), ("youtube", "abcdef2", 2), ("facebook", "https://f/only", 1), ("instagram", "a", 1), ("instagram", "b", 2), ("forum", "one", 1), ("x", None, 9), ("x", " ", 9)]
ROWS = [
    ("x", {"sourceTweetId": "99", "conversationId": 20, "inReplyToId": "10"}, ("20", "lookup", 1)),
    ("x", {"conversationId": "99", "inReplyToTweetId": "10"}, ("10", "lookup", 1)),
    ("x", {"conversationId": "99"}, (None, None, 0)),
    ("tiktok", {"aweme_id": 77}, ("https://t/@a/video/77", "lookup", 2)),
    ("tiktok", {"aweme_id": "1", "videoId": "77"}, (None, None, 0)),
    ("youtube", {"videoUrl": "https://www.y/watch?v=abcdef2&t=1"}, ("abcdef2", "lookup", 1)),
    ("youtube", {"videoId": "zzz", "pageUrl": "https://y/watch?v=abcdef1"}, ("https://y/watch?v=abcdef1", "literal", 0)),
    ("youtube", {"url": "https://y/shorts/abcdef1"}, ("https://youtu.be/abcdef1", "lookup", 1)),
    ("facebook", {"postUrl": "p", "inputUrl": "i"}, ("p", "literal", 0)),
    ("facebook", {"facebookUrl": " "}, ("https://f/only", "only", 0)),
    ("instagram", {"postUrl": None}, (None, None, 0)),
    ("forum", {}, ("one", "only", 0)),
    ("other", {"postUrl": "p"}, (None, None, 0)),
]


def test_attribution(spark):
    df = spark.createDataFrame([(i, s, json.dumps(x)) for i, (s, x, _) in enumerate(ROWS)] + [(90, "forum", None), (91, None, "{}"), (92, "x", "bad")], "id int, source string, raw string")
    got = {r["id"]: (r["parent_post"], r["rule"], r["matches"]) for r in C.attribute_parents(df, spark.createDataFrame(SEEDS, "source string, ref string, ord int")).collect()}
    assert [got[i] for i in range(len(ROWS))] == [w for *_, w in ROWS]
    assert got[90] == ("one", "only", 0) and got[91] == got[92] == (None, None, 0)


def test_records(spark):
    seeds = spark.createDataFrame([("x", "10", 1), ("facebook", "f", 1)], "source string, ref string, ord int")
    about = spark.createDataFrame([("x", "10", " about ", 0.51239, True, "")], "source string, ref string, text string, market_score double, qualified boolean, tier string")
    raws = [
        ("x", {"id": "10", "text": "the post itself", "conversationId": "10"}), ("x", {"id": "11", "text": " hi ", "inReplyToId": "10", "conversationId": "10", "likeCount": "7", "createdAt": 1705312800}),
        ("x", {"tweetId": "11", "text": "again"}), ("x", {"text": "  "}), ("x", {"text": None}), ("tiktok", {"cid": 5, "commentText": "t", "reply_id": "0"}), ("tiktok", {"cid": 6, "text": "t", "reply_id": "5", "user": {"nickname": "nick"}}),
        ("facebook", {"message": "m", "threadingDepth": 1}), ("forum", {"content": "c", "user": {"name": "n"}, "date": "never"}),
    ]
    df = spark.createDataFrame([(i, s, json.dumps(x), None) for i, (s, x) in enumerate(raws)], "key int, source string, raw string, parent_id string")
    got = {r["id"]: r for r in C.normalize_comments(df, seeds, about, F.lit(NOW).cast("timestamp")).collect()}
    assert len(got) == 5 and set(got) >= {"comment:x:11", "comment:tiktok:5", "comment:tiktok:6"}
    x = got["comment:x:11"]
    assert (x["text"], x["likes"], x["parent_comment_id"], x["parent_context"], x["parent_market_score"], x["evidence_layer"], x["parent_subject_qualified"]) == ("hi", 7, None, "about", 0.5124, "reply", True)
    assert str(x["date"]) == "2024-01-15 10:00:00" and got["comment:tiktok:5"]["evidence_layer"] == "comment" and got["comment:tiktok:6"]["evidence_layer"] == "reply" and got["comment:tiktok:6"]["author"] == "nick"
    rest = [r for k, r in got.items() if not k.startswith(("comment:x", "comment:tiktok"))]
    assert {(r["platform"], r["evidence_layer"], r["date"], r["parent_post"], len(r["comment_id"])) for r in rest} == {("facebook", "reply", None, "f", 24), ("forum", "comment", None, None, 24)}


def test_context_of_a_shared_address(spark):
    """Conversations that share an address keep their own context, once for each post asked for; without ``same`` all of it."""
    df = spark.createDataFrame([(i, c, "youtube", json.dumps({"commentId": str(i), "comment": "t", "videoUrl": "https://y/watch?v=abcdef1"}), None) for i, c in enumerate("abc")], "key int, conv string, source string, raw string, parent_id string")
    seeds = spark.createDataFrame([("youtube", "https://y/watch?v=abcdef1", 1), ("youtube", "https://y/watch?v=abcdef1", 2)], "source string, ref string, ord int")
    about = spark.createDataFrame([("youtube", "https://y/watch?v=abcdef1", c, f"about {c}") for c in "aab"], "source string, ref string, conv string, text string").selectExpr("*", "0.5D AS market_score", "true AS qualified", "'' AS tier")
    out = C.normalize_comments(df, seeds, about, F.lit(NOW).cast("timestamp"), same=("conv",)).collect()
    assert sorted((r["comment_id"], r["parent_context"], r["parent_market_score"]) for r in out if r["parent_context"]) == [("0", "about a", 0.5), ("0", "about a", 0.5), ("1", "about b", 0.5)]
    assert [(r["comment_id"], r["parent_market_score"], r["parent_subject_qualified"]) for r in out if not r["parent_context"]] == [("2", 0.0, False)]
    assert C.normalize_comments(df, seeds, about.drop("conv"), F.lit(NOW).cast("timestamp")).count() == 9
