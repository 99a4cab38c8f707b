"""Languages, thresholds and settings from the environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

#: Page types by name.
PAGE_TYPES = {"ARTICLE": 1, "CATEGORY": 2, "REDIRECT": 3, "DISAMBIGUATION": 4, "TEMPLATE": 5, "DANGLING_REDIRECT": 6, "UNPARSEABLE": 7, "UNHANDLED": 8}
ARTICLE, CATEGORY, REDIRECT, DISAMBIGUATION, TEMPLATE, DANGLING_REDIRECT, UNPARSEABLE, UNHANDLED = PAGE_TYPES.values()
#: Namespaces that a dump must define.
NAMESPACES = {"MAIN": 0, "SPECIAL": -1, "FILE": 6, "TEMPLATE": 10, "CATEGORY": 14}
#: The measures' and contexts' parameters.
MAX_NGRAM_TOKENS, MIN_LINK_PROBABILITY, MAX_REDIRECTS = 10, 0.0025, 16
CONTEXT_SIZE, CANDIDATE_CAP, OTHER_TOPICS, MAX_CATEGORIES = 25, 125, 25, 20
MIN_SENSE_TRAIN, MIN_SENSE_SERVE, LINK_CUTOFF = 0.01, 0.02, 0.25
DISTANCE_SAMPLE = 100_000
#: Stands for a removed template inside text.
PLACEHOLDER = "\ue000"


@dataclass(frozen=True)
class TrainingProfile:
    min_out_links: int = 15
    min_in_links: int = 20
    max_list_proportion: float = 0.1
    min_word_count: int = 400
    max_word_count: int = 4000
    disambiguator_groups: tuple[tuple[str, int], ...] = ()
    linking_groups: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Language:
    code: str
    name: str
    disambiguation_prefixes: tuple[str, ...]
    profile: TrainingProfile = field(default_factory=TrainingProfile)
    category_name: str = "Category"

    @property
    def wiki_prefix(self) -> str:
        """How a link names this language's own pages."""
        return ":simple:" if self.code == "en_simple" else f":{self.code}:"

    @staticmethod
    def from_json(text: str) -> dict[str, Language]:
        """Languages by code, from a JSON list of records (code, name, disambiguationPrefixes, trainingProfile)."""
        found = {}
        for r in json.loads(text):
            p = r.get("trainingProfile", {})
            groups = {k: tuple((g["name"], int(g["size"])) for g in p.get(k, ())) for k in ("disambiguatorGroup", "linkingGroup")}
            profile = TrainingProfile(p.get("minOutLinks", 15), p.get("minInLinks", 20), p.get("maxListProportion", 0.1), p.get("minWordCount", 400), p.get("maxWordCount", 4000), groups["disambiguatorGroup"], groups["linkingGroup"])
            found[r["code"]] = Language(r["code"], r["name"], tuple(r["disambiguationPrefixes"]), profile)
        return found

    def stored(self) -> str:
        """As the configuration table holds it."""
        return json.dumps(asdict(self))

    @staticmethod
    def restored(data: str) -> Language:
        r = json.loads(data)
        groups = {k: tuple((name, size) for name, size in r["profile"][k]) for k in ("disambiguator_groups", "linking_groups")}
        return Language(**r | {"disambiguation_prefixes": tuple(r["disambiguation_prefixes"]), "profile": TrainingProfile(**r["profile"] | groups)})


#: The languages' names of disambiguation templates, and their training profiles (links out and in, share
#: of list items, words, and the names and sizes of groups).
LANGUAGES = Language.from_json("""[
  {"code": "en", "name": "English",
   "disambiguationPrefixes": ["dab", "disambiguation", "disambig", "geodis", "schooldis", "call sign disambiguation", "airport disambiguation", "genus disambiguation", "school disambiguation"],
   "trainingProfile": {"minOutLinks": 15, "minInLinks": 20, "maxListProportion": 0.1, "minWordCount": 400, "maxWordCount": 4000,
     "disambiguatorGroup": [{"name": "disambiguation-train", "size": 5000}, {"name": "disambiguation-test", "size": 2000}],
     "linkingGroup": [{"name": "linking-train", "size": 5000}, {"name": "linking-test", "size": 2000}]}},
  {"code": "en_simple", "name": "English (simple)", "disambiguationPrefixes": ["dab", "disambiguation", "disambig", "geodis"],
   "trainingProfile": {"minOutLinks": 2, "minInLinks": 3, "maxListProportion": 0.1, "minWordCount": 150, "maxWordCount": 4000,
     "disambiguatorGroup": [{"name": "disambiguation-train", "size": 1000}, {"name": "disambiguation-test", "size": 500}],
     "linkingGroup": [{"name": "linking-train", "size": 1000}, {"name": "linking-test", "size": 500}]}},
  {"code": "fr", "name": "Français", "disambiguationPrefixes": ["homonymie"],
   "trainingProfile": {"minOutLinks": 15, "minInLinks": 20, "maxListProportion": 0.1, "minWordCount": 400, "maxWordCount": 4000,
     "disambiguatorGroup": [{"name": "disambiguation-train", "size": 5000}, {"name": "disambiguation-test", "size": 2000}],
     "linkingGroup": [{"name": "linking-train", "size": 5000}, {"name": "linking-test", "size": 2000}]}}
]""")
ENGLISH, SIMPLE_ENGLISH, FRENCH = LANGUAGES["en"], LANGUAGES["en_simple"], LANGUAGES["fr"]


@dataclass(frozen=True)
class Settings:
    profile: str = "DEFAULT"
    language: str = "en"
    languages_file: str = "languages.json"
    workers: int = 0  # 0: as many as the machine has
    compress: bool = True

    @property
    def chosen(self) -> Language:
        """The configured language: of the file that is named, else of those that come with the engine."""
        known = LANGUAGES
        if os.path.exists(self.languages_file):
            with open(self.languages_file, encoding="utf-8") as f:
                known = Language.from_json(f.read())
        if self.language not in known:
            raise ValueError(f"no language {self.language}: {', '.join(sorted(known))}")
        return known[self.language]

    @staticmethod
    def from_environment(env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return Settings(env.get("PROFILE", "DEFAULT"), env.get("WP_LANG", "en"), env.get("LANGUAGES_FILE", "languages.json"), int(env.get("N_WORKERS", "0")), env.get("COMPRESS_MARKUP", "true").lower() == "true")

    @property
    def master(self) -> str:
        return f"local[{self.workers or '*'}]"
