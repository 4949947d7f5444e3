"""Collection and chat from end to end on small tables."""

from datetime import datetime

from presswork.functions.encoder import EncoderSpec, HashedNgrams, embed
from presswork.operators.retrieval import NOTHING_FOUND
from presswork.plans.chat_turn import close_turns, encode_questions, open_turns
from presswork.plans.collect import collect_feeds
from presswork.schemas import CHAT_HISTORY, CHAT_SESSIONS
from tests.test_sources import land

NOW = datetime(2024, 3, 1, 12)


def entry(title, url, date, body):
    return (
        f"<item><title>{title}</title><link>{url}</link><pubDate>{date}</pubDate>"
        f"<description>{body}</description></item>"
    )


def test_collect(spark, tmp_path):
    body = "A description that is long enough to be stored by the collector. " * 2
    good = "Fri, 01 Mar 2024 10:00:00 +0900"
    land(tmp_path, 1, "<rss><channel>" + entry("a", "u1", good, body) + entry("b", "u2", good, "short")
         + entry("c", "u3", good, body) + "</channel></rss>")
    land(tmp_path, 2, "<rss><channel>" + entry("a", "u1", good, body) + entry("d", "u4", "?", body)
         + entry("e", "u5", good, body) + "</channel></rss>")
    sources = spark.createDataFrame([(1, 1), (2, 2)], "source_id int, category_id int")
    stored = spark.createDataFrame([(100, "u3")], "article_id long, url string")
    added, stats = collect_feeds(spark, str(tmp_path), sources, stored, NOW)
    assert {(r.url, r.source_id, r.category_id) for r in added.collect()} == {("u1", 1, 1), ("u5", 2, 2)}
    assert sorted(r.article_id for r in added.collect()) == [101, 102]
    assert sorted(map(tuple, stats.collect())) == [(1, 3, 1, 2), (2, 3, 1, 2)]


def test_chat_turns(spark):
    small = EncoderSpec(lambda: HashedNgrams(128))
    texts = ["Schools get a larger budget this year.", "Heavy rain closed the mountain road."]
    chunks = embed(
        spark.createDataFrame(
            [(i, i, t) for i, t in enumerate(texts)], "chunk_id long, article_id long, content string"
        ),
        "content", spec=small,
    )
    articles = spark.createDataFrame(
        [(i, 1, 1, f"T{i}", f"u{i}", NOW, True, False) for i in range(2)],
        "article_id long, source_id int, category_id int, title string, url string, published_at timestamp_ntz, is_processed boolean, is_duplicate boolean",
    )
    categories = spark.createDataFrame([(1, "c")], "category_id int, name string")
    sources = spark.createDataFrame([(1, 1, "p_c")], "source_id int, category_id int, name string")
    prefs = spark.createDataFrame([(1, 1, 9)], "user_id long, category_id int, weight int")
    history = spark.createDataFrame([(7, "s", "user", "Hello", datetime(2024, 1, 1))], CHAT_HISTORY)
    sessions = spark.createDataFrame([("s", 1, datetime(2024, 1, 1), datetime(2024, 1, 1))], CHAT_SESSIONS)
    questions = encode_questions(
        spark.createDataFrame(
            [(1, "s", 1, "Was the mountain road closed by rain?"), (2, "n", 2, "Is there a school budget?")],
            "query_id long, session_id string, user_id long, question string",
        ),
        small,
    )
    turn = open_turns(questions, sessions, history, chunks, articles, categories, sources, prefs, NOW, k=1)
    assert {(r.session_id, r.updated_at) for r in turn.sessions.collect()} == {("s", NOW), ("n", NOW)}
    assert sorted(r.chat_id for r in turn.messages.collect()) == [8, 9]
    prompts = {r.query_id: r for r in turn.prompts.collect()}
    assert texts[1] in prompts[1].prompt and texts[0] in prompts[2].prompt
    assert "[USER]\nHello\n\n[USER]\nWas the mountain" in prompts[1].prompt
    assert "Hello" not in prompts[2].prompt

    answers = spark.createDataFrame([(1, "s", "Yes."), (2, "n", "Yes.")], "query_id long, session_id string, answer string")
    said, cited = close_turns(answers, history.unionByName(turn.messages), turn.sources, None, NOW)
    assert sorted(r.chat_id for r in said.collect()) == [10, 11]
    by_session = {r.session_id: r.chat_id for r in said.collect()}
    assert {(r.chat_id, r.article_id, r["rank"]) for r in cited.collect()} == {
        (by_session["s"], 1, 1), (by_session["n"], 0, 1)
    }

    # Two turns of one session in a batch: each answer keeps its own sources.
    twice = spark.createDataFrame([(1, "s", "Yes."), (2, "s", "No.")], "query_id long, session_id string, answer string")
    said, cited = close_turns(twice, history, turn.sources, None, NOW)
    answer = {r.chat_id: r.message for r in said.collect()}
    assert len(answer) == 2
    assert sorted((answer[r.chat_id], r.article_id) for r in cited.collect()) == [("No.", 0), ("Yes.", 1)]

    nothing = open_turns(questions, sessions, history, chunks.limit(0), articles, categories, sources, prefs, NOW)
    assert {r.reply for r in nothing.prompts.collect()} == {NOTHING_FOUND}
