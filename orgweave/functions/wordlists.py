"""Word lists and registry field names: fixed values, kept as data."""

from __future__ import annotations

# Alias attributes too general to link two organisations.
STOP_ATTRIBUTES = [
    "Telemedia", "sprint", "cloud", "network", "tech", "telemedia", "powernet", "unicom", "link net", "telkom", "telin", "datacom",
    "ultranet", "intercom", "informatica", "cable", "telecom", "fiber", "meganet", "citizens", "citizens bank", "delta", "gmbh", "cnet",
    "pty ltd", "inc", "coop", "limited", "square", "department of information and communication", "telenet",
    "department of information and communications", "ministry of education", "watchtower bible and tract society", "signal",
    "ministry of finance", "unity", "nova", "bull", "metronet", "quest", "start", "syntax", "teleperformance", "freedom", "dialog",
    "interlink", "spark", "optimum", "globe", "apnic", "cablevision", "ministry of communication", "internet solutions", "switch",
    "national information technology center", "planet", "opera", "ministry of health", "next", "sas institute",
    "ministry of foreign affairs", "supernet", "netcom", "extreme", "link", "epic", "deutsche bundespost", "business solutions",
    "ministry of interior", "interior ministry", "microsoft network", "the microsoft network", "horizon tv", "ltda me",
    "cooperativa de obras y servicios publicos", "cooperativa de obras y servicios publicos de canals limitada",
]
# Words of an organisation's name that bar it from alias attributes.
INSTITUTION_WORDS = ["university", "college", "city", "wireless (us) inc"]
# Parts of a name, and whole names, that are never judged.
BLOCKED_PARTS = ["ministry", "govern", "nuance"]
BLOCKED_NAMES = ["company", "NUANCE COMMUNICATIONS LIMITED", "Nuance Transcription Services India Private Limited"]
# Organisations whose links users reported as wrong.
REPORTED_NAMES = [
    "Netspace Services Limited", "Raiffeisen Rechenzentrum GmbH", "SIRI TECH SYSTEMS PRIVATE LIMITED",
    "Cyber Internet Services (Private) Limited", "figueiredo provedores eireli",
]
# Extra attributes of brands, by a part of the lower-case name.
BRAND_ATTRIBUTES = {
    "chinanet": ["chinanet coop", "chinanet coop.", "chinanet coop,"],
    "google": ["google coop", "google coop.", "google coop,"],
    "at&t": ["at&t coop", "at&t coop.", "at&t coop,", "at & t corp"],
    "internet systems consortium": ["internet systems consortium", "internet systems consortium.", "internet systems consortium,"],
}
# Registry names in the order in which they are looked for.
REGISTRIES = ["ripe", "apnic", "lacnic", "arin", "afrinic"]
# Keys that a relation answer must have.
RELATION_KEYS = ["base_org_name", "candidate_org_name", "reasoning for Alias", "reasoning for Parent/Subsidiary", "relationship", "parent", "parent name"]
# Public suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "com.br", "net.br", "org.br", "co.jp", "ne.jp", "or.jp", "ad.jp",
    "com.cn", "net.cn", "org.cn", "co.in", "net.in", "com.mx", "com.ar", "net.ar", "com.tr", "net.tr", "co.za", "net.za", "com.pl",
    "net.pl", "com.ua", "net.ua", "co.nz", "net.nz", "com.sg", "com.hk", "com.tw", "co.kr", "co.id", "net.id",
]
