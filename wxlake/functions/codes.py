"""Code tables of bulletins as data, and columns that look values up in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of event classes, actions, significances and hydrologic fields, with their names.
EVENT_CLASSES = {"O": "Operational", "T": "Test", "E": "Experimental", "X": "ExperimentalVtecInOperationalProduct"}
ACTIONS = {"NEW": "new", "CON": "continue", "EXT": "extend_time", "EXA": "extend_area", "EXB": "extend_area_and_time", "UPG": "upgrade", "CAN": "cancel", "EXP": "expire", "COR": "correction", "ROU": "routine"}
SIGNIFICANCES = {"W": "Warning", "A": "Watch", "Y": "Advisory", "S": "Statement", "F": "Forecast", "O": "Outlook", "N": "Synopsis"}
FLOOD_SEVERITIES = {"N": "NoneExpected", "0": "NotClassified", "1": "Minor", "2": "Moderate", "3": "Major", "U": "Unknown"}
FLOOD_CAUSES = tuple("ER SM RS DM GO IJ IC FS FT ET WT DR MC OT UU".split())
FLOOD_RECORDS = tuple("OO NO NR UU".split())

# Phenomena.
PHENOMENA = tuple("AF AS BH BW BZ CF DF DS DU EC EH EW FA FF FG FL FR FW FZ GL HF HT HU HW HY HZ IS LE LO LS LW MA MF MH MS RP SC SE SM SR SS SQ SU SV TO TR TS TY UP WC WI WS WW ZF ZR ZY".split())
HYDROLOGIC = ("FA", "FF", "FL", "HY")

# Product identifiers of each family.
PRODUCT_FAMILIES = {
    "tornado": "TOR",
    "severe-thunderstorm": "SVR",
    "flash-flood": "FFW",
    "flood": "FLW FLS FLN ESF FFG FFH FFS",
    "marine": "MWW SMW GLF CWF MWS NSH HSF CPF OFF MAW MFM MIM MRP MVF OSW SRF SRD GLS ICE IDM IOB",
    "discussion": "AFD PMD SWO HMD",
    "forecast": "ZFP SFP LFP AFM AFP EFP EOL NOW OZF PFM PRE CCF COD FTP RDF TAV TVL PRB PTS QPF RTP NWR AWO AWS AWU SFT",
    "statement": "SPS SVS",
    "hydrology": "RVS RVD RVA RWR RVF RVI RVM RVR HYD HYM ESG ESP ESS LKE MAP POE QPS RNS RRS RRA RRM RSD RSM HML",
    "watch": "WSW FFA WCN WOU SEL SAW AVA AVW AVG SAB SAG",
    "advisory": "HWO NPW CFW AQA AQI ASA DSA SDS DDO CWA CWS",
    "administrative": "PNS ADR ADM ADA FTM KPA NOX SOO DMO RMT RWT MTT RET FSH INI GRE VER",
    "winter-weather": "SQW FZL WSF EWS",
    "tropical": "TCD TCP TCM TWO TWS HLS TWD TCU TCV PWS PSH CHG TCE SPF STD TCS",
    "fire-weather": "RFW FWF FWD FWS AFW FDI PFW FRW FWA FWM FWN FWO FWL SMF RFD STQ",
    "aviation": "TAF SIG OFA TAP VFT AWW WST WSV OAV",
    "tsunami": "TSU TIB EQI TMA",
    "observation": "MTR LSR LTG BOY SHP SSM OBS DSM SDO LCO MAN SGL ABV OUA CGR TID HRR HWR BRG PRC MOB LLS LOW RRY AGO",
    "climate": "CLI CLM LCD RER CF6 CLA CLQ CLS CMM MSM STA STP TPT CLT SCD SCN",
}
PREFIX_FAMILIES = {"WA": "aviation", "WS": "aviation", "FA": "aviation", "FD": "aviation", "RR": "hydrology", "HD": "hydrology", "HP": "hydrology"}
FAMILIES = (*PRODUCT_FAMILIES, "unknown")
#: Families whose products carry no event codes, left out when event reports list an archive.
WITHOUT_EVENTS = ("discussion", "forecast", "administrative")

# Families by phenomenon, of products without an identifier and of events.
PHENOMENON_FAMILIES = {"TO": "tornado", "SV": "severe-thunderstorm", "FF": "flash-flood", "FL": "flood", "MA": "marine", "SC": "marine", "GL": "marine", "SR": "marine", "HF": "marine"}
EVENT_FAMILIES = PHENOMENON_FAMILIES | {"FA": "flood"}
TITLE_FAMILIES = {"TORNADO WARNING": "tornado", "SEVERE THUNDERSTORM WARNING": "severe-thunderstorm", "FLASH FLOOD WARNING": "flash-flood"}

# Tags of the form NAME...VALUE, lifecycle statuses and quality flags in their order.
TEXT_TAGS = ("TORNADO", "HAIL THREAT", "MAX HAIL SIZE", "WIND THREAT", "MAX WIND GUST", "FLASH FLOOD DAMAGE THREAT", "TSTM DAMAGE THREAT", "TORNADO DAMAGE THREAT", "THREAT", "SOURCE", "IMPACT")
STATUSES = ("future", "pending", "active", "superseded", "canceled", "expired")


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The value of a key, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), key)


def product_family(pil: Column) -> Column:
    """Family of a three-letter product identifier: an exact one, else by its first two letters, else unknown."""
    exact = {code: family for family, codes in PRODUCT_FAMILIES.items() for code in codes.split()}
    by_prefix = F.when(F.length(pil) >= 3, looked_up(F.substring(pil, 1, 2), PREFIX_FAMILIES))
    return F.coalesce(looked_up(pil, exact), by_prefix, F.lit("unknown"))


def snake(family: Column) -> Column:
    return F.translate(family, "-", "_")
