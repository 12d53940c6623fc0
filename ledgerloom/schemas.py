"""Explicit schemas; nothing in the library infers one."""

from pyspark.sql import types as T

EVIDENCE = "array<struct<label:string,text:string,url:string>>"
LOCATIONS = f"struct<countryCodes:array<string>,scope:string,evidence:{EVIDENCE}>"
GEOGRAPHY = f"struct<status:string,evidence:{EVIDENCE}>"
IDENTITY_CLAIM = "struct<authority:string,reference:string,granularity:string,lotId:string,proofUrl:string>"
LOCALES = f"array<struct<locale:string,detailNeedsRefresh:boolean,sourceUrl:string,title:string,description:string,evidence:{EVIDENCE},publishedAt:date,deadline:date>>"

NOTICE = (
    "source string, sourceKey string, sourceUrl string, title string, description string, publishedAt date, deadline date, kind string, "
    f"evidence {EVIDENCE}, geography {GEOGRAPHY}, locations {LOCATIONS}, identityClaim {IDENTITY_CLAIM}, fetchedAt timestamp, contentHash string, "
    f"detailStatus string, deadlineConflict boolean, applicationStatus string, locales {LOCALES}"
)

PROFILE = (
    "organizationName string, organizationType string, sectors array<string>, capabilities string, locations array<string>, alertsEnabled boolean, "
    "pastWork string, teamCapacity string, languages array<string>, budgetMin int, budgetMax int, qualifications array<string>, interests array<string>, "
    "excludedWork array<string>, opportunityTypes array<string>"
)
EVENT = "actor string, action string, entity string, entity_id string, detail string, created_at timestamp"
STREAM_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LEDGER = "owner_id long, item_id string, claim string, source_type string, source_ref string, status string"
REGISTER = "register_id long, node_id string, kind string, label string, unit string, unit_kind string, members array<string>, value double, asserted double, basis string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
