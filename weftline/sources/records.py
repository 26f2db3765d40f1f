"""Source records to table rows: forum, parliament and game payloads, and answer documents in XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import join_strings, keys_where_true, parse_date, parse_release_date
from weftline.functions.text import clean_speaker, python_bool
from weftline.operators.joins import normalise_members
from weftline.session import written

SPEECH = "speaker string, recorded string, answer string"


#: The parts of each source's records that are read; everything else is ignored.
PAYLOADS = {
    "oireachtas_questions": "question struct<uri:string,questionNumber:string,questionType:string,date:string,showAs:string,`by`:struct<showAs:string,uri:string,memberCode:string>,`to`:struct<showAs:string,uri:string,roleCode:string,roleType:string>,house:struct<showAs:string,chamberType:string,committeeCode:string>,debateSection:struct<uri:string,showAs:string,formats:struct<xml:struct<uri:string>>>>",
    "oireachtas_members": "member struct<pId:string,memberCode:string,firstName:string,fullName:string,showAs:string,gender:string,dateOfDeath:string,memberships:array<struct<membership:struct<uri:string,house:struct<houseCode:string,houseNo:string>,dateRange:struct<start:string,end:string>,parties:array<struct<party:struct<partyCode:string,showAs:string,dateRange:struct<start:string,end:string>>>>,represents:array<struct<represent:struct<representCode:string,showAs:string,representType:string>>>>>>>",
    "oireachtas_parties": "party struct<showAs:string,partyCode:string,house:struct<houseCode:string,houseNo:string>>, house struct<houseCode:string,houseNo:string>",
    "oireachtas_debates": "debateRecord struct<date:string,debateSections:array<struct<debateSection:struct<debateSectionId:string,showAs:string,contributions:array<struct<text:string,speaker:struct<showAs:string,uri:string,role:string>,contributionType:string>>>>>>",
    "boards": "discussionID string, type string, name string, body string, categoryID string, dateInserted string, dateUpdated string, dateLastComment string, insertUserId bigint, updateUserID bigint, lastUserID bigint, closed boolean, countComments bigint, canonicalUrl string",
    "boards_comments": "commentID bigint, discussionID bigint, parentRecordType string, parentRecordID bigint, name string, categoryID int, body string, dateInserted string, dateUpdated string, updateUserID bigint, score int, depth int, scoreChildComments int, countChildComments int, url string, type string, format string, attributes string",
    "steam_review": "AppID bigint, total_reviews bigint, total_positive bigint, total_negative bigint, review_score bigint, review_score_desc string",
    "steam_current_user": "AppID bigint, player_count bigint",
    "steam_app_list": "appid bigint, name string, last_modified bigint",
    "steam_store": "data struct<steam_appid:bigint,name:string,type:string,is_free:boolean,developers:array<string>,publishers:array<string>,platforms:map<string,boolean>,categories:array<struct<description:string>>,genres:array<struct<description:string>>,supported_languages:string,price_overview:struct<currency:string,initial:bigint,final:bigint,discount_percent:bigint>,recommendations:struct<total:bigint>,metacritic:struct<score:bigint,url:string>,release_date:struct<date:string>,content_descriptors:struct<ids:array<int>>>",
}


def parsed(raw: DataFrame, connector: str, column: str = "value") -> DataFrame:
    """A connector's JSON texts as typed columns."""
    ddl = PAYLOADS[connector]
    text = F.concat(F.lit('{"data":'), F.col(column), F.lit("}")) if connector == "steam_store" else F.col(column)
    return raw.select(F.from_json(text, ddl).alias("r")).select("r.*")


def comment_rows(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("dateInserted", "dateUpdated")})


def rows_of(raw: DataFrame, connector: str) -> dict[str, tuple[DataFrame, list[str]]]:
    """What a connector's records become: table name -> (rows, key)."""
    df = parsed(raw, connector)
    if connector == "oireachtas_questions":
        return {"oireachtas_questions": (question_rows(df), ["QuestionURI"])}
    if connector == "oireachtas_parties":
        return {"oireachtas_parties": (party_rows(df), ["PartyCode", "HouseCode", "HouseNo"])}
    if connector == "oireachtas_debates":
        sections, contributions = debate_rows(df)
        return {"oireachtas_debate_sections": (sections, ["DebateSectionId"]), "oireachtas_debate_contributions": (contributions, ["DebateSectionId", "Sequence"])}
    if connector == "oireachtas_members":
        t = normalise_members(df)
        return {"oireachtas_members": (t["members"], ["pId"]), "oireachtas_member_memberships": (t["memberships"], ["membership_id"]), "oireachtas_member_party_memberships": (t["parties"], ["membership_id", "partyCode"]), "oireachtas_member_representations": (t["representations"], ["membership_id", "representCode"])}
    if connector == "boards":
        return {"boards_discussions": (discussion_rows(df), ["DiscussionId"])}
    if connector == "boards_comments":
        return {"boards_comments": (comment_rows(df), ["commentID"])}
    if connector == "steam_store":
        return {"steam_games": (df.select(*game_row()), ["AppID"])}
    if connector == "steam_review":
        names = {"total_reviews": "Total_Reviews", "total_positive": "Total_Positive", "total_negative": "Total_Negative", "review_score": "Review_Score", "review_score_desc": "Review_Score_Desc"}
        return {"steam_review": (df.select("AppID", *(F.col(a).alias(b) for a, b in names.items())).where("AppID is not null"), ["AppID"])}
    if connector == "steam_current_user":
        return {"steam_current_user": (df.select("AppID", F.col("player_count").alias("Current_Players"), F.current_timestamp().cast("timestamp_ntz").alias("Current_Players_Last_Updated")).where("AppID is not null"), ["AppID"])}
    if connector == "steam_app_list":
        return {"steam_apps": (df.select(F.col("appid").alias("AppID"), F.col("name").alias("Name"), F.timestamp_seconds("last_modified").cast("timestamp_ntz").alias("Last_Modified")).where("AppID is not null"), ["AppID"])}
    raise KeyError(f"records of {connector!r} have no table")


def _speech(text: str | None) -> tuple:
    """Speaker, time and paragraphs of the first speech, at any namespace; nothing for a document without one."""
    if not text:
        return None, None, None
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return None, None, None
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    speech = next((e for e in root.iter() if local(e) == "speech"), None)
    if speech is None:
        return None, None, None
    time = next((e.get("time") for e in speech.iter() if local(e) == "recordedTime"), None)
    paragraphs = ("".join(e.itertext()).strip() for e in speech.iter() if local(e) == "p")
    return (speech.get("by") or "").lstrip("#") or None, time, "\n".join(p for p in paragraphs if p)


def parse_answers(df: DataFrame, key: str, xml: str) -> DataFrame:
    """``key, speaker, recorded, answer`` of XML documents, an Arrow batch at a time; unreadable ones give nulls."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_speech(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], pa.string()) for i in range(3))], [key, "speaker", "recorded", "answer"])

    return df.select(key, F.col(xml).cast("string").alias("_xml")).mapInArrow(run, f"`{key}` {kind}, {SPEECH}")


def fetched(df: DataFrame, key: str, transport) -> DataFrame:
    """``key, xml`` of the documents at the distinct addresses of a column, each asked for once: the table itself is the cache.

    ``transport(url, params)`` gives (status, text); an address that gives none has null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            got = [transport(u, {}) for u in urls]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text if status == 200 else None for status, text in got], pa.string())], [key, "xml"])

    urls = df.select(F.col(key).cast("string").alias(key)).where(f"`{key}` is not null").distinct()
    return urls.mapInArrow(run, f"`{key}` string, xml string")


def with_answers(questions: DataFrame, transport, uri: str = "AnswerXMLURI") -> DataFrame:
    """Question rows with ``AnswerText``, ``AnswerSpeaker`` and ``AnswerRecordedTime`` of the document their address names.

    Every address is fetched and parsed once, however many questions share it; the fetched documents are written before they
    are joined, so that no retry of the join asks the service again. A question without a document keeps nulls.
    """
    documents = written(fetched(questions, uri, transport), "answers")
    answers = parse_answers(documents, uri, "xml")
    rest = [c for c in questions.columns if c not in ("AnswerText", "AnswerSpeaker", "AnswerRecordedTime")]
    joined = questions.select(*rest).join(answers, uri, "left")
    return joined.select(*rest, F.col("answer").alias("AnswerText"), F.col("speaker").alias("AnswerSpeaker"), F.try_to_timestamp("recorded").cast("timestamp_ntz").alias("AnswerRecordedTime"))


def question_rows(df: DataFrame, record: str = "question") -> DataFrame:
    """Question payloads as rows; a record without uri is left out, of repeated uris one stays."""
    q = lambda p: F.col(f"{record}.{p}")
    return df.select(
        q("uri").alias("QuestionURI"), q("questionNumber").cast("bigint").alias("QuestionNumber"), q("questionType").alias("QuestionType"), parse_date(q("date")).alias("QuestionDate"), q("showAs").alias("QuestionText"),
        q("by.showAs").alias("AskedBy"), q("by.uri").alias("AskedByURI"), q("by.memberCode").alias("AskedByMemberCode"), q("to.showAs").alias("ToMinister"), q("to.uri").alias("ToMinisterURI"), q("to.roleCode").alias("ToRoleCode"), q("to.roleType").alias("ToRoleType"),
        q("house.showAs").alias("House"), q("house.chamberType").alias("ChamberType"), q("house.committeeCode").alias("CommitteeCode"), q("debateSection.uri").alias("DebateSectionURI"), q("debateSection.showAs").alias("DebateSectionShowAs"), q("debateSection.formats.xml.uri").alias("AnswerXMLURI"),
    ).where("QuestionURI is not null").dropDuplicates(["QuestionURI"])


def party_rows(df: DataFrame) -> DataFrame:
    """Party records, wrapped or mapped."""
    return df.select(F.col("party.showAs").alias("PartyShowAs"), F.col("party.partyCode").alias("PartyCode"), F.coalesce("party.house.houseCode", "house.houseCode").alias("HouseCode"), F.coalesce("party.house.houseNo", "house.houseNo").cast("int").alias("HouseNo"))


def debate_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Debate records as section rows and contribution rows with their place; sections without id and contributions without text are left out."""
    s = df.select(F.col("debateRecord.date").alias("d"), F.explode("debateRecord.debateSections.debateSection").alias("s")).where("s.debateSectionId is not null")
    sections = s.select(F.col("s.debateSectionId").alias("DebateSectionId"), parse_date(F.col("d")).alias("DebateDate"), F.col("s.showAs").alias("Title"), F.to_json("s").alias("RawJSON"))
    c = s.select(F.col("s.debateSectionId").alias("DebateSectionId"), F.posexplode("s.contributions").alias("at", "c")).where("c.text is not null and c.text != ''")
    contributions = c.select(
        "DebateSectionId", F.col("c.speaker.showAs").alias("SpeakerName"), F.col("c.speaker.uri").alias("SpeakerURI"), F.col("c.speaker.role").alias("SpeakerRole"), F.col("c.contributionType").alias("ContributionType"), F.col("c.text").alias("ContributionText"), (F.col("at") + 1).cast("bigint").alias("Sequence"), F.to_json("c").alias("RawJSON"),
    )
    return sections, contributions


def discussion_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("discussionID").cast("bigint").alias("DiscussionId"), F.col("type").alias("Type"), F.col("name").alias("Title"), F.col("body").alias("Body"), F.col("categoryID").cast("int").alias("CategoryId"),
        *(F.try_to_timestamp(F.col(c)).alias(c[0].upper() + c[1:]) for c in ("dateInserted", "dateUpdated", "dateLastComment")),
        "insertUserId", F.col("updateUserID").alias("UpdateUserId"), F.col("lastUserID").alias("LastUserId"), python_bool(F.col("closed")).alias("Closed"), "countComments", F.col("canonicalUrl").alias("CanonicalURL"),
    )


def game_row(payload: str = "data", store: str = "https://store.steampowered.com/app/") -> list[Column]:
    """A nested store record as flat columns; whatever is missing is null."""
    p = lambda x: F.col(f"{payload}.{x}")
    return [
        p("steam_appid").cast("bigint").alias("AppID"), p("name").alias("Name"), p("type").alias("Type"), python_bool(p("is_free")).alias("Is_Free"),
        join_strings(p("developers")).alias("Developers"), join_strings(p("publishers")).alias("Publishers"), F.concat(F.lit(store), p("steam_appid").cast("string")).alias("URL"),
        keys_where_true(p("platforms")).alias("Platforms"), join_strings(p("categories"), "description").alias("Categories"), join_strings(p("genres"), "description").alias("Genres"),
        p("supported_languages").alias("Supported_Languages"), p("price_overview.currency").alias("Price_Currency"), p("price_overview.initial").cast("bigint").alias("Price_Initial"), p("price_overview.final").cast("bigint").alias("Price_Final"), p("price_overview.discount_percent").cast("bigint").alias("Price_Discount_Percent"),
        p("recommendations.total").cast("bigint").alias("Recommendations"), p("metacritic.score").cast("bigint").alias("Metacritic_Score"), p("metacritic.url").alias("Metacritic_URL"), parse_release_date(p("release_date.date")).alias("Release_Date"), join_strings(p("content_descriptors.ids")).alias("Content_Descriptors"),
    ]


def speaker(c: Column) -> Column:
    return clean_speaker(c)
