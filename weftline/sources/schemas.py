"""The catalogued entities: column types, keys and links. Constraints are checked by queries; Spark does not enforce them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entity:
    table: str
    ddl: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    links: tuple[tuple[str, str, str], ...] = ()  # (column, entity, its column)

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)


ENTITIES = {
    "BoardsComment": Entity("boards_comments", "Id bigint, commentID bigint, discussionID bigint, parentRecordType string, parentRecordID bigint, name string, categoryID int, body string, dateInserted timestamp_ntz, dateUpdated timestamp_ntz, updateUserID bigint, score int, depth int, scoreChildComments int, countChildComments int, url string, type string, format string, attributes string", ("Id",), (("commentID",),), (("discussionID", "BoardsDiscussion", "DiscussionId"),)),
    "BoardsDiscussion": Entity("boards_discussions", "Id bigint, DiscussionId bigint, Type string, Title string, Body string, CategoryId int, DateInserted timestamp_ntz, DateUpdated timestamp_ntz, DateLastComment timestamp_ntz, insertUserId bigint, UpdateUserId bigint, LastUserId bigint, Closed string, countComments bigint, CanonicalURL string", ("Id",), (("DiscussionId",),)),
    "OireachtasQuestion": Entity("oireachtas_questions", "Id bigint, QuestionURI string, QuestionNumber bigint, QuestionType string, QuestionDate date, QuestionText string, AskedBy string, AskedByURI string, AskedByMemberCode string, ToMinister string, ToMinisterURI string, ToRoleCode string, ToRoleType string, House string, ChamberType string, CommitteeCode string, DebateSectionURI string, DebateSectionShowAs string, AnswerXMLURI string, AnswerText string, AnswerSpeaker string, AnswerRecordedTime timestamp_ntz", ("Id",), (("QuestionURI",),)),
    "OireachtasDebateSection": Entity("oireachtas_debate_sections", "Id bigint, DebateSectionId string, DebateDate date, QuestionURI string, Title string, RawJSON string", ("Id",), (("DebateSectionId",),), (("QuestionURI", "OireachtasQuestion", "QuestionURI"),)),
    "OireachtasDebateContribution": Entity("oireachtas_debate_contributions", "Id bigint, DebateSectionId string, SpeakerName string, SpeakerURI string, SpeakerRole string, ContributionType string, ContributionText string, Sequence bigint, RawJSON string", ("Id",), (), (("DebateSectionId", "OireachtasDebateSection", "DebateSectionId"),)),
    "OireachtasMember": Entity("oireachtas_members", "pId string, memberCode string, firstName string, fullName string, showAs string, gender string, dateOfDeath date", ("pId",)),
    "OireachtasMemberMembership": Entity("oireachtas_member_memberships", "membership_id bigint, pId string, houseCode string, houseNo int, membership_start_date date, membership_end_date date, membership_uri string", ("membership_id",), (("pId", "houseCode", "houseNo", "membership_uri"),), (("pId", "OireachtasMember", "pId"),)),
    "OireachtasMemberPartyMembership": Entity("oireachtas_member_party_memberships", "id bigint, membership_id bigint, partyCode string, party_showAs string, party_start_date date, party_end_date date", ("id",), (("membership_id", "partyCode", "party_start_date"),), (("membership_id", "OireachtasMemberMembership", "membership_id"),)),
    "OireachtasMemberRepresentation": Entity("oireachtas_member_representations", "id bigint, membership_id bigint, representCode string, representShowAs string, representType string", ("id",), (), (("membership_id", "OireachtasMemberMembership", "membership_id"),)),
    "OireachtasParty": Entity("oireachtas_parties", "Id bigint, PartyShowAs string, PartyCode string, HouseCode string, HouseNo int", ("Id",)),
    "RobloxGame": Entity("roblox_games", "Id bigint, Date timestamp_ntz, Active_Users bigint, Favorites bigint, Total_Visits string, Date_Created date, Last_Updated date, Server_Size bigint, Genre string, Title string, Creator string, gameID bigint, Category string, URL string, Description string", ("Id",)),
    "SteamGame": Entity("steam_games", "Id bigint, AppID bigint, Name string, Type string, Is_Free string, Developers string, Publishers string, URL string, Platforms string, Categories string, Genres string, Tags string, Supported_Languages string, Price_Currency string, Price_Initial bigint, Price_Final bigint, Price_Discount_Percent bigint, Total_Reviews bigint, Total_Positive bigint, Total_Negative bigint, Review_Score bigint, Review_Score_Desc string, Recommendations bigint, Metacritic_Score bigint, Metacritic_URL string, Release_Date timestamp_ntz, Content_Descriptors string, Current_Players bigint, Current_Players_Last_Updated timestamp_ntz", ("Id",)),
}


def key_violations(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, or hold a null: ``keys..., n``."""
    null = None
    for k in keys:
        null = F.col(k).isNull() if null is None else null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null)


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose link points nowhere."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti")
