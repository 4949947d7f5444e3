"""Rows every new installation starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.operators.joins import absent_from

# Sections.
SEED_CATEGORIES = ["정치", "경제", "사회"]

# publisher_section, feed address, section number.
SEED_SOURCES = [
    ("연합뉴스_정치", "https://www.yna.co.kr/rss/politics.xml", 1),
    ("연합뉴스_경제", "https://www.yna.co.kr/rss/economy.xml", 2),
    ("매일경제_정치", "https://www.mk.co.kr/rss/30200030/", 1),
    ("매일경제_경제", "https://www.mk.co.kr/rss/30100041/", 2),
    ("매일경제_사회", "https://www.mk.co.kr/rss/50400012/", 3),
    ("한국경제_정치", "https://www.hankyung.com/feed/politics", 1),
    ("한국경제_경제", "https://www.hankyung.com/feed/economy", 2),
    ("한국경제_사회", "https://www.hankyung.com/feed/society", 3),
    ("경향신문_정치", "https://www.khan.co.kr/rss/rssdata/politic.xml", 1),
    ("경향신문_경제", "https://www.khan.co.kr/rss/rssdata/economy.xml", 2),
    ("SBS_정치", "https://news.sbs.co.kr/news/SectionRssFeed.do?sectionId=01", 1),
    ("SBS_경제", "https://news.sbs.co.kr/news/SectionRssFeed.do?sectionId=02", 2),
]


def _numbered(new: DataFrame, existing: DataFrame, id_column: str) -> DataFrame:
    """New seed rows, of which there are a few, with ids after the highest stored one."""
    highest = existing.agg(F.max(id_column)).first()[0] or 0
    place = F.row_number().over(W.orderBy("position"))
    return new.withColumn(id_column, (place + highest).cast("int"))


def add_categories(existing: DataFrame) -> DataFrame:
    """Stored categories plus the seed categories whose name is not stored yet."""
    seeds = existing.sparkSession.createDataFrame(
        list(enumerate(SEED_CATEGORIES)), "position int, name string"
    )
    new = _numbered(absent_from(seeds, existing, ["name"]), existing, "category_id")
    return existing.unionByName(new.select(*existing.columns))


def add_sources(existing: DataFrame, categories: DataFrame) -> DataFrame:
    """Stored sources plus the seed sources whose feed address is not stored yet.

    A source belongs to the stored category of its section's name, whatever id that has.
    """
    rows = [
        (i, name, url, SEED_CATEGORIES[section - 1], True)
        for i, (name, url, section) in enumerate(SEED_SOURCES)
    ]
    seeds = existing.sparkSession.createDataFrame(
        rows, "position int, name string, rss_url string, section string, is_active boolean"
    )
    sections = categories.select("category_id", F.col("name").alias("section"))
    placed = absent_from(seeds, existing, ["rss_url"]).join(sections, "section")
    return existing.unionByName(
        _numbered(placed, existing, "source_id").select(*existing.columns)
    )
