"""Fixed column layouts of the tables the operators exchange."""

from pyspark.sql import types as T

ITEMS = T.StructType([
    T.StructField("brief_id", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("transcript", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("views", T.LongType()),
    T.StructField("likes", T.LongType()),
    T.StructField("comments", T.LongType()),
    T.StructField("duration", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("authority", T.StringType()),
    T.StructField("lang", T.StringType()),
])

FEEDBACK_EVENTS = T.StructType([
    T.StructField("event_ord", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("reaction", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("domain", T.StringType()),
])

REQUEST_LOG = T.StructType([
    T.StructField("event_ord", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("url", T.StringType()),
])

# One landed response of the video details endpoint.
VIDEO_PAYLOAD = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("channelId", T.StringType()),
            T.StructField("channelTitle", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("publishedAt", T.StringType()),
        ])),
        T.StructField("statistics", T.StructType([
            T.StructField("viewCount", T.StringType()),
            T.StructField("likeCount", T.StringType()),
            T.StructField("commentCount", T.StringType()),
        ])),
        T.StructField("contentDetails", T.StructType([
            T.StructField("duration", T.StringType()),
        ])),
    ]))),
])

# One feed document. RSS keeps its entries under channel/item, Atom under entry.
_RSS_ENTRY = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content:encoded", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("dc:date", T.StringType()),
])
_ATOM_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", T.StringType()),
        T.StructField("_rel", T.StringType()),
    ]))),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
])
FEED_DOCUMENT = T.StructType([
    T.StructField("channel", T.StructType([
        T.StructField("item", T.ArrayType(_RSS_ENTRY)),
    ])),
    T.StructField("entry", T.ArrayType(_ATOM_ENTRY)),
    T.StructField("_unread", T.StringType()),  # the document, where it is not well-formed
])

RULE_TABLES = {
    "domains": "domain STRING, ord INT",
    "domain_keywords": "domain STRING, domain_ord INT, keyword STRING, kw_ord INT",
    "search_keywords": "domain STRING, keyword STRING, ord INT",
    "channels": "channel_id STRING, domain STRING, ord INT",
    "feeds": "url STRING, name STRING, lang STRING, domains ARRAY<STRING>, authority STRING, ord INT",
    "whitelist": "channel STRING",
    "spam_keywords": "keyword STRING",
}
