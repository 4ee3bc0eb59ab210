"""Fixed values the survey and its users' vocabulary prescribe.

These are data, not logic: labels as the questionnaire prints them, the codes
they stand for, and everyday names for institutions, fields and agencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

# --- fixed values: questionnaire ---------------------------------------------
FUNDING_LINE = r"^01\.[a-g]$"
FEDERAL_QUESTION = "Federal expenditures by field and agency"
NONFEDERAL_QUESTION = "Nonfederal expenditures by field and source"
ALL_FIELDS_ROW = "All"
TOTAL_COLUMN = "Total"

# --- fixed values: printed funding-source label -> column ---------------------
SOURCE_RENAMES = {
    "federal_government": "federal",
    "state_and_local_government": "state_local",
    "nonprofit_organizations": "nonprofit",
    "institution_funds": "institutional",
    "all_other_sources": "other_sources",
    "total": "total_rd",
}

# --- fixed values: agency code -> display name --------------------------------
AGENCY_NAMES = {
    "DOD": "Dept of Defense",
    "DOE": "Dept of Energy",
    "HHS": "HHS (incl. NIH)",
    "NASA": "NASA",
    "NSF": "NSF",
    "USDA": "USDA",
    "Other agencies": "Other Federal",
}

# --- fixed values: field taxonomy: printed label -> (code, parent code, is_parent)
FIELD_TAXONOMY = {
    "Computer and information sciences, all": ("cs", "cs", 1),
    "Engineering, all": ("engineering", "engineering", 1),
    "Engineering, aerospace, aeronautical, and astronautical": ("eng_aerospace", "engineering", 0),
    "Engineering, bioengineering and biomedical engineering": ("eng_biomedical", "engineering", 0),
    "Engineering, chemical": ("eng_chemical", "engineering", 0),
    "Engineering, civil": ("eng_civil", "engineering", 0),
    "Engineering, electrical, electronic, and communications": ("eng_electrical", "engineering", 0),
    "Engineering, industrial and manufacturing": ("eng_industrial", "engineering", 0),
    "Engineering, mechanical": ("eng_mechanical", "engineering", 0),
    "Engineering, metallurgical and materials": ("eng_materials", "engineering", 0),
    "Engineering, other": ("eng_other", "engineering", 0),
    "Geosciences, atmospheric sciences, and ocean sciences, all": ("geosciences", "geosciences", 1),
    "Geosciences, atmospheric sciences, and ocean sciences, atmospheric science and meteorology":
        ("geo_atmospheric", "geosciences", 0),
    "Geosciences, atmospheric sciences, and ocean sciences, geological and earth sciences":
        ("geo_earth", "geosciences", 0),
    "Geosciences, atmospheric sciences, and ocean sciences, ocean sciences and marine sciences":
        ("geo_ocean", "geosciences", 0),
    "Geosciences, atmospheric sciences, and ocean sciences, other": ("geo_other", "geosciences", 0),
    "Life sciences, all": ("life_sciences", "life_sciences", 1),
    "Life sciences, agricultural sciences": ("life_agricultural", "life_sciences", 0),
    "Life sciences, biological and biomedical sciences": ("life_biomedical", "life_sciences", 0),
    "Life sciences, health sciences": ("life_health", "life_sciences", 0),
    "Life sciences, natural resources and conservation": ("life_natural_resources", "life_sciences", 0),
    "Life sciences, other": ("life_other", "life_sciences", 0),
    "Mathematics and statistics, all": ("math", "math", 1),
    "Physical sciences, all": ("physical_sciences", "physical_sciences", 1),
    "Physical sciences, astronomy and astrophysics": ("phys_astronomy", "physical_sciences", 0),
    "Physical sciences, chemistry": ("phys_chemistry", "physical_sciences", 0),
    "Physical sciences, materials science": ("phys_materials", "physical_sciences", 0),
    "Physical sciences, physics": ("phys_physics", "physical_sciences", 0),
    "Physical sciences, other": ("phys_other", "physical_sciences", 0),
    "Psychology, all": ("psychology", "psychology", 1),
    "Social sciences, all": ("social_sciences", "social_sciences", 1),
    "Social sciences, anthropology": ("soc_anthropology", "social_sciences", 0),
    "Social sciences, economics": ("soc_economics", "social_sciences", 0),
    "Social sciences, political science and government": ("soc_political", "social_sciences", 0),
    "Social sciences, sociology, demography, and population studies":
        ("soc_sociology", "social_sciences", 0),
    "Social sciences, other": ("soc_other", "social_sciences", 0),
    "Other sciences, all": ("other_sciences", "other_sciences", 1),
    "Non-S&E, all": ("non_se", "non_se", 1),
    "Non-S&E, business management and business administration": ("nse_business", "non_se", 0),
    "Non-S&E, communication and communications technologies": ("nse_communication", "non_se", 0),
    "Non-S&E, education": ("nse_education", "non_se", 0),
    "Non-S&E, humanities": ("nse_humanities", "non_se", 0),
    "Non-S&E, law": ("nse_law", "non_se", 0),
    "Non-S&E, social work": ("nse_social_work", "non_se", 0),
    "Non-S&E, visual and performing arts": ("nse_arts", "non_se", 0),
    "Non-S&E, other": ("nse_other", "non_se", 0),
}

# --- fixed values: parent code -> short label ----------------------------------
FIELD_SHORT_LABELS = {
    "cs": "Computer Science",
    "engineering": "Engineering",
    "geosciences": "Geosciences",
    "life_sciences": "Life Sciences",
    "math": "Math & Statistics",
    "physical_sciences": "Physical Sciences",
    "psychology": "Psychology",
    "social_sciences": "Social Sciences",
    "other_sciences": "Other Sciences",
    "non_se": "Non-S&E",
}

# --- fixed values: sub-fields first surveyed in 2016 --------------------------
FIELDS_SINCE_2016 = ["eng_industrial", "life_natural_resources", "phys_materials", "soc_anthropology"]
FIELDS_SINCE_YEAR = 2016

# --- fixed values: landmark ranks, panel start, growth floor, quota -----------
ANCHOR_RANKS = [1, 10, 25, 50, 100, 250, 500, 750]
FIRST_YEAR = 2010
GROWTH_FLOOR = 1_000_000
QUOTA_LIMIT = 50
QUOTA_SECONDS = 3600

# --- fixed values: institution nickname -> part of the full name --------------
INSTITUTION_ALIASES = {
    "MIT": "Massachusetts Institute of Technology",
    "Caltech": "California Institute of Technology",
    "Georgia Tech": "Georgia Institute of Technology",
    "GT": "Georgia Institute of Technology",
    "UNT": "University of North Texas",
    "UT Austin": "University of Texas at Austin",
    "UCLA": "University of California, Los Angeles",
    "UCSD": "University of California, San Diego",
    "UCSF": "University of California, San Francisco",
    "UC Berkeley": "University of California, Berkeley",
    "UCB": "University of California, Berkeley",
    "USC": "University of Southern California",
    "UNC": "University of North Carolina at Chapel Hill",
    "OSU": "Ohio State University",
    "PSU": "Pennsylvania State University",
    "UMich": "University of Michigan",
    "UW": "University of Washington",
    "NYU": "New York University",
    "CMU": "Carnegie Mellon",
    "TAMU": "Texas A&M University",
    "Texas A&M": "Texas A&M University",
    "JHU": "Johns Hopkins University",
    "Hopkins": "Johns Hopkins University",
    "UF": "University of Florida",
    "UVA": "University of Virginia",
    "Vandy": "Vanderbilt University",
    "Wash U": "Washington University in St. Louis",
    "WashU": "Washington University in St. Louis",
    "Rice": "Rice University",
    "Purdue": "Purdue University",
    "Penn": "University of Pennsylvania",
    "UPenn": "University of Pennsylvania",
    "Penn State": "Pennsylvania State University",
    "ASU": "Arizona State University",
    "CU Boulder": "University of Colorado Boulder",
    "Duke": "Duke University",
    "Yale": "Yale University",
    "Harvard": "Harvard University",
    "Stanford": "Stanford University",
    "Cornell": "Cornell University",
    "Princeton": "Princeton University",
    "Northwestern": "Northwestern University",
    "Emory": "Emory University",
}

# --- fixed values: everyday word -> field code --------------------------------
FIELD_TERMS = {
    "biomedical engineering": "eng_biomedical",
    "BME": "eng_biomedical",
    "biomed eng": "eng_biomedical",
    "comp sci": "cs",
    "CS": "cs",
    "computer science": "cs",
    "econ": "soc_economics",
    "economics": "soc_economics",
    "poli sci": "soc_political",
    "political science": "soc_political",
    "physics": "phys_physics",
    "chemistry": "phys_chemistry",
    "chem": "phys_chemistry",
    "astronomy": "phys_astronomy",
    "astro": "phys_astronomy",
    "bio": "life_sciences",
    "biology": "life_sciences",
    "ag": "life_agricultural",
    "agriculture": "life_agricultural",
    "health sciences": "life_health",
    "non-science": "non_se",
    "non-S&E": "non_se",
    "humanities": "nse_humanities",
    "materials": "phys_materials",
    "materials science": "phys_materials",
}

# --- fixed values: everyday word -> agency code -------------------------------
AGENCY_TERMS = {
    "NIH": "HHS",
    "National Institutes of Health": "HHS",
    "Pentagon": "DOD",
    "military": "DOD",
    "defense": "DOD",
    "energy": "DOE",
    "agriculture": "USDA",
    "space": "NASA",
}


def taxonomy_rows() -> list[tuple[str, str, str, int]]:
    """(label, code, parent, is_parent) for each parent and sub-field."""
    return [(label, *codes) for label, codes in FIELD_TAXONOMY.items()]


def field_codes() -> list[str]:
    return sorted(code for code, _parent, _level in FIELD_TAXONOMY.values())


# The tables below have a fixed number of rows, so they carry the broadcast hint.


def taxonomy(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(taxonomy_rows(), schema.TAXONOMY))


def aliases(spark: SparkSession) -> DataFrame:
    return F.broadcast(
        spark.createDataFrame(list(INSTITUTION_ALIASES.items()), "alias string, full_name string")
    )


def terms(spark: SparkSession) -> DataFrame:
    rows = [(t, "field", c) for t, c in FIELD_TERMS.items()]
    rows += [(t, "agency", c) for t, c in AGENCY_TERMS.items()]
    return F.broadcast(spark.createDataFrame(rows, "term string, kind string, code string"))


def lookup(mapping: dict[str, str], key):
    """A literal-map lookup column: the value, or null for an unknown key."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
