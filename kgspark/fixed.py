"""Dictionaries, thresholds and formats that results depend on.

Everything in this module is data. All of it is small and constant, so it may
be used as literals or joined as a broadcast table at any scale.
"""

from __future__ import annotations

from typing import NamedTuple, Optional


class EntityType(NamedTuple):
    name: str
    folder: str
    jw_threshold: float
    semantic_threshold: float
    token_overlap: bool
    min_people: int
    phonetic: bool


# Entity types with their folders and matching thresholds.
ENTITY_TYPES = [
    EntityType("Person", "People", 0.92, 0.92, False, 1, True),
    EntityType("Organization", "Organizations", 0.85, 0.92, True, 2, False),
    EntityType("Project", "Projects", 0.85, 0.92, True, 2, False),
    EntityType("Location", "Locations", 0.90, 0.92, True, 2, False),
    EntityType("Concept", "Concepts", 0.75, 0.88, False, 2, False),
    EntityType("Meeting", "Meetings", 0.90, 0.92, True, 1, False),
    EntityType("Practice", "Practices", 0.80, 0.90, True, 2, False),
    EntityType("Pattern", "Patterns", 0.80, 0.90, True, 2, False),
    EntityType("CaseStudy", "CaseStudies", 0.85, 0.92, True, 2, False),
    EntityType("Bioregion", "Bioregions", 0.85, 0.92, True, 2, False),
    EntityType("Protocol", "Protocols", 0.85, 0.92, True, 2, False),
    EntityType("Playbook", "Playbooks", 0.85, 0.92, True, 2, False),
    EntityType("Question", "Questions", 0.75, 0.88, False, 2, False),
    EntityType("Claim", "Claims", 0.75, 0.88, False, 2, False),
    EntityType("Evidence", "Evidence", 0.80, 0.90, True, 2, False),
]
UNKNOWN_TYPE = EntityType("Unknown", "Misc", 0.90, 0.95, True, 2, False)

# Token-overlap rule of the fuzzy tier.
MIN_OVERLAP_RATIO = 0.5
MIN_OVERLAP_COUNT = 2

# Identifier formats.
ENTITY_URI_PREFIX = "orn:personal-koi.entity:"
NETWORK_RID_PREFIX = "orn:koi-net."
WEB_RID_PREFIX = "orn:web.page:"
NOTE_RID_PREFIXES = ["orn:obsidian.entity:Notes/", "vault:notes/", "vault:"]
NODE_RID_PREFIX = "orn:koi-net.node:"
RID_TYPE_PATTERNS = [r"koi-net\.([^:]+):", r"entity:([^/]+)/"]

# Stop words and title words skipped when the first significant token is taken.
GLOBAL_STOPWORDS = ["the", "a", "an"]
TYPE_STOPWORDS = {"Person": ["dr", "mr", "mrs", "ms", "prof"]}

# Spelling variants folded together before phonetic coding.
PHONETIC_NAMES = {
    "sean": "shawn",
    "siobhan": "shivon",
    "niamh": "neeve",
    "caoimhe": "keeva",
    "cian": "kian",
    "ciara": "kiara",
    "aisling": "ashling",
    "aoife": "eefa",
    "saoirse": "seersha",
    "eoin": "owen",
    "padraig": "patrick",
    "tadhg": "tige",
    "iain": "ian",
    "rhys": "reese",
    "siân": "shan",
}

# Link folders (lower case) and the entity type each one implies.
LINK_FOLDERS = {
    "people": "Person", "person": "Person",
    "organizations": "Organization", "organization": "Organization", "orgs": "Organization",
    "projects": "Project", "project": "Project",
    "locations": "Location", "location": "Location", "places": "Location",
    "concepts": "Concept", "concept": "Concept",
    "practices": "Practice", "practice": "Practice",
    "patterns": "Pattern", "pattern": "Pattern",
    "casestudies": "CaseStudy", "casestudy": "CaseStudy",
    "bioregions": "Bioregion", "bioregion": "Bioregion",
    "protocols": "Protocol", "protocol": "Protocol",
    "playbooks": "Playbook", "playbook": "Playbook",
    "questions": "Question", "question": "Question",
    "claims": "Claim", "claim": "Claim",
    "evidence": "Evidence",
}


class Predicate(NamedTuple):
    name: str
    field: str
    subject_types: Optional[list[str]]
    object_types: Optional[list[str]]


_RELATED = ["Person", "Organization", "Project", "Concept", "Practice", "Pattern", "CaseStudy",
            "Bioregion", "Protocol", "Question", "Claim", "Evidence"]
_ABOUT_SUBJECTS = ["Evidence", "Claim", "Question", "Protocol", "Playbook"]
_ABOUT_OBJECTS = ["Practice", "Pattern", "CaseStudy", "Concept", "Project", "Bioregion"]
_LINEAGE = ["Project", "Concept", "Practice"]

# Predicates, their preferred note field, and declared subject / object types.
PREDICATES = [
    Predicate("affiliated_with", "affiliation", ["Person"], ["Organization"]),
    Predicate("founded", "founder", ["Person"], ["Organization", "Project"]),
    Predicate("has_founder", "founders", ["Organization", "Project"], ["Person"]),
    Predicate("knows", "knows", ["Person"], ["Person"]),
    Predicate("collaborates_with", "collaborators", ["Person"], ["Person"]),
    Predicate("involves_person", "people", ["Project", "Meeting"], ["Person"]),
    Predicate("involves_organization", "parentOrg", ["Project"], ["Organization"]),
    Predicate("has_project", "projects", ["Organization"], ["Project"]),
    Predicate("attended", "attendees", ["Person"], ["Meeting"]),
    Predicate("located_in", "location", None, ["Location"]),
    Predicate("aggregates_into", "patterns", ["Practice"], ["Pattern"]),
    Predicate("suggests", "suggests", ["Pattern"], ["Practice"]),
    Predicate("documents", "documents", ["CaseStudy"], ["Practice", "Pattern"]),
    Predicate("practiced_in", "bioregion", ["Practice"], ["Bioregion", "Location"]),
    Predicate("supports", "supports", ["Evidence", "Claim"], ["Claim"]),
    Predicate("opposes", "opposes", ["Evidence", "Claim"], ["Claim"]),
    Predicate("informs", "informs", ["Evidence", "Claim"], ["Question", "Protocol"]),
    Predicate("generates", "generates", ["Playbook", "Question"], ["Evidence", "Question"]),
    Predicate("implemented_by", "implementedBy", ["Protocol"], ["Playbook"]),
    Predicate("synthesizes", "synthesizes", ["Claim"], ["Evidence"]),
    Predicate("about", "about", _ABOUT_SUBJECTS, _ABOUT_OBJECTS),
    Predicate("broader", "broader", ["Concept", "Bioregion"], ["Concept", "Bioregion"]),
    Predicate("narrower", "narrower", ["Concept", "Bioregion"], ["Concept", "Bioregion"]),
    Predicate("related_to", "relatedTo", _RELATED, _RELATED),
    Predicate("forked_from", "forkedFrom", _LINEAGE, _LINEAGE),
    Predicate("builds_on", "buildsOn", _LINEAGE, _LINEAGE),
    Predicate("inspired_by", "inspiredBy", _LINEAGE, _LINEAGE),
]
SYMMETRIC_PREDICATES = ["knows", "collaborates_with"]
PREDICATE_NAME_PATTERN = "^[a-z][a-z0-9_]*$"


class NoteField(NamedTuple):
    field: str
    predicate: str
    direction: str
    default_type: Optional[str]


# Note fields (lower case), the predicate each writes, whether the
# note is the subject ("out") or the object ("in"), and the default target type.
NOTE_FIELDS = [
    NoteField("affiliation", "affiliated_with", "out", "Organization"),
    NoteField("memberof", "affiliated_with", "out", "Organization"),
    NoteField("organization", "affiliated_with", "out", "Organization"),
    NoteField("organizations", "affiliated_with", "out", "Organization"),
    NoteField("founder", "founded", "out", None),
    NoteField("founderof", "founded", "out", None),
    NoteField("founders", "has_founder", "in", "Person"),
    NoteField("creator", "has_founder", "in", "Person"),
    NoteField("knows", "knows", "out", "Person"),
    NoteField("friendswith", "knows", "out", "Person"),
    NoteField("collaborateswith", "collaborates_with", "out", "Person"),
    NoteField("collaborators", "collaborates_with", "out", "Person"),
    NoteField("people", "involves_person", "out", "Person"),
    NoteField("participants", "involves_person", "out", "Person"),
    NoteField("members", "involves_person", "out", "Person"),
    NoteField("lead", "involves_person", "out", "Person"),
    NoteField("parentorg", "involves_organization", "out", "Organization"),
    NoteField("projects", "has_project", "out", "Project"),
    NoteField("attendees", "attended", "in", "Person"),
    NoteField("location", "located_in", "out", "Location"),
    NoteField("headquarters", "located_in", "out", "Location"),
    NoteField("aggregatesinto", "aggregates_into", "out", "Pattern"),
    NoteField("aggregates_into", "aggregates_into", "out", "Pattern"),
    NoteField("patterns", "aggregates_into", "out", "Pattern"),
    NoteField("practices", "aggregates_into", "in", "Practice"),
    NoteField("suggests", "suggests", "out", "Practice"),
    NoteField("suggestedby", "suggests", "in", "Pattern"),
    NoteField("documentedby", "documents", "in", "CaseStudy"),
    NoteField("documented_by", "documents", "in", "CaseStudy"),
    NoteField("documents", "documents", "out", None),
    NoteField("bioregion", "practiced_in", "out", "Bioregion"),
    NoteField("practicedin", "practiced_in", "out", "Bioregion"),
    NoteField("practiced_in", "practiced_in", "out", "Bioregion"),
    NoteField("supports", "supports", "out", None),
    NoteField("opposes", "opposes", "out", None),
    NoteField("informs", "informs", "out", None),
    NoteField("generates", "generates", "out", None),
    NoteField("implementedby", "implemented_by", "out", "Playbook"),
    NoteField("implemented_by", "implemented_by", "out", "Playbook"),
    NoteField("implements", "implemented_by", "in", "Protocol"),
    NoteField("protocol", "implemented_by", "in", "Protocol"),
    NoteField("synthesizes", "synthesizes", "out", "Evidence"),
    NoteField("about", "about", "out", None),
    NoteField("broader", "broader", "out", "Concept"),
    NoteField("narrower", "narrower", "out", "Concept"),
    NoteField("relatedto", "related_to", "out", None),
    NoteField("related_to", "related_to", "out", None),
    NoteField("forkedfrom", "forked_from", "out", None),
    NoteField("forked_from", "forked_from", "out", None),
    NoteField("buildson", "builds_on", "out", None),
    NoteField("builds_on", "builds_on", "out", None),
    NoteField("inspiredby", "inspired_by", "out", None),
    NoteField("inspired_by", "inspired_by", "out", None),
]

# Type labels in rendered notes.
SCHEMA_LABELS = {"Person": "schema:Person", "Organization": "schema:Organization", "Location": "schema:Place"}
PREFIXED_TYPES = ["Practice", "Pattern", "CaseStudy", "Bioregion", "Protocol", "Playbook",
                  "Question", "Claim", "Evidence"]
TYPE_PREFIX = "bkc:"

# Synonyms of extracted field names.
FIELD_SYNONYMS = {
    "headquarters": "location", "hq": "location", "based_in": "location", "based in": "location",
    "members": "people", "team": "people", "staff": "people", "employees": "people",
    "parent_organization": "parentOrg", "parent_org": "parentOrg", "parent organization": "parentOrg",
    "website": "website", "url": "website",
    "expertise": "expertise", "role": "role", "title": "role",
    "methodology": "methodology", "outcomes": "outcomes", "status": "status",
    "geographic_scope": "bioregion", "geographic scope": "bioregion", "region": "bioregion",
    "affiliation": "affiliation", "affiliations": "affiliation",
    "organization": "affiliation", "organizations": "affiliation",
    "founder": "founder", "founded_by": "founders", "founded by": "founders",
    "projects": "projects",
}

# Short names of the sensors that documents come from.
SOURCE_SENSORS = {"email": "email-sensor", "vault": "obsidian-sensor", "github": "github-sensor"}

# Event queue and monitoring settings.
EVENT_TTL_HOURS = 24
POLL_LIMIT = 50
USER_RATE_PER_HOUR = 5
GLOBAL_RATE_PER_HOUR = 20
SPARSE_PAGE_WORDS = 50
CONFIDENCE_EPSILON = 0.001
MAX_PEER_FAILURES = 3
BACKOFF_BASE_SECONDS = 30.0
BACKOFF_MAX_SECONDS = 600.0

# Chunk sizes in words.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
CHUNK_MIN = 100

# Statuses of a submitted page.
PAGE_STATUSES = ["pending", "previewed", "evaluated", "ingested", "rejected", "error", "monitoring"]

# Files a repository scan reads, skips, and how they are named.
CODE_EXTENSIONS = ["py", "ts", "tsx", "js", "jsx"]
DOC_EXTENSIONS = ["md", "yaml", "yml", "json", "toml", "sql", "sh"]
OTHER_EXTENSIONS = ["css", "html", "env.example", "cfg", "ini"]
SKIPPED_FOLDERS = ["node_modules", "venv", ".venv", "__pycache__", ".git", ".mypy_cache",
                   ".pytest_cache", "dist", "build", ".tox", "egg-info", ".eggs"]
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript",
             "jsx": "javascript", "sql": "sql"}
NOTE_EXTENSIONS = ["md", "py", "ts", "sql", "yaml", "yml", "json", "sh"]
