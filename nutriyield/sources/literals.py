"""Literal lookup tables.

The tables under "FIXED VALUES" must equal the published study values for
results to be right; they are written plainly, in their natural order.
Everything else here (the brand -> taxon map used to stand driver tables in
for catch records) is our own choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# =============================================================================
# FIXED VALUES (study constants; must equal the published values)
# =============================================================================

# Nutrient names in table order, before and after renaming.
NUTRIENTS_MU = ["Selenium_mu", "Zinc_mu", "Protein_mu", "Omega_3_mu",
                "Calcium_mu", "Iron_mu", "Vitamin_A_mu"]
NUTRIENTS = ["selenium", "zinc", "protein", "omega3", "calcium", "iron", "vitaminA"]
NUTRIENTS_NO_SE = NUTRIENTS[1:]

# Recommended daily intake conversion factor per nutrient (as used by the code,
# not the config file).
RDI = [
    ("selenium", 0.000026),
    ("zinc", 0.0049),
    ("protein", 46.0),
    ("omega3", 2.939),
    ("calcium", 1.0),
    ("iron", 0.0294),
    ("vitaminA", 0.0005),
]

# Catch groups: (catch_name, family, interagency_code), file order.
CATCH_GROUPS = [
    ("Lobster", None, "SLV"),
    ("Seaweed", None, "SWX"),
    ("Sea cucumber", None, "CUX"),
    ("Short mackerel", "Scombridae", "RAX"),
    ("Mackerel scad", "Carangidae", "SDX"),
    ("Jacks/Trevally", "Carangidae", "CGX"),
    ("Tuna/Bonito", "Scombridae", "TUN"),
    ("Fusilier", "Caesionidae", "CJX"),
    ("Sardines/pilchards", "Clupeidae", "CLP"),
    ("Garfish", "Hemiramphidae", "GZP"),
    ("Soldierfish", "Holocentridae", "YDX"),
    ("Long tom", "Belonidae", "BEN"),
    ("Snapper/seaperch", "Lutjanidae", "SNA"),
    ("Spinefoot", "Siganidae", "SPI"),
    ("Grouper", "Serranidae", "GPX"),
    ("Emperor", "Lethrinidae", "EMP"),
    ("Parrotfish", "Scaridae", "PWT"),
    ("Triggerfish", "Balistidae", "TRI"),
    ("Flying fish", "Exocoetidae", "FLY"),
    ("Unicornfish", "Acanthuridae", "SUR"),
    ("Mojarra/Silverbelly", "Gerreidae", "MOJ"),
    ("Jobfish", "Lutjanidae", "LWX"),
    ("Wrasse", "Labridae", "WRA"),
    ("Barracuda", "Sphyraenidae", "BAR"),
    ("Chub", "Kyphosidae", "KYX"),
    ("Octopus", "Octopodidae", "OCZ"),
    ("Moonfish", "Menidae", "MOO"),
    ("Moontail bullseye", "Priacanthidae", "BWH"),
    ("Ponyfish", "Leiognathidae", "LGE"),
    ("Bream", "Nemipteridae", "MOB"),
    ("Blackspot sweeper", "Pempheridae", "MHL"),
    ("Goatfish", "Mullidae", "GOX"),
    ("Mullet", "Mugilidae", "MUL"),
    ("Terapon", "Terapontidae", "THO"),
    ("Shark", "Carcharhinidae", "SKH"),
    ("Sweetlips", "Haemulidae", "GRX"),
    ("Moray", "Muraenidae", "MUI"),
    ("Sergeant", "Pomacentridae", "DSF"),
    ("Shrimp", None, "PEZ"),
    ("Butterflyfish", "Chaetodontidae", "IHX"),
    ("Cardinalfish", "Apogonidae", "APO"),
    ("Cuttlefish", "Sepiidae", "IAX"),
    ("Javelin/Grunt", "Haemulidae", "BGX"),
    ("Sailfish", "Istiophoridae", "SFA"),
    ("Cobia", "Rachycentridae", "CBA"),
    ("Crab", None, "CRA"),
    ("Dolphinfish", "Coryphaenidae", "DOX"),
    ("Milkfish", "Chanidae", "MIL"),
    ("Threadfin", "Polynemidae", "THF"),
    ("Cockles", "Cardiidae", "COZ"),
    ("Remora", "Echeneidae", "ECN"),
    ("Tripodfish", "Triacanthidae", "PUX"),
    ("Wolf herring", "Chirocentridae", "DOS"),
    ("Stingrays", None, "SRX"),
    ("Sicklefish", "Drepaneidae", "DRZ"),
    ("Other", None, "MZZ"),
]

# Invertebrate code lists of the food-composition table and the code each maps to.
FAO_GROUPS = [
    ("OCZ", ["OCT", "OCT"]),
    ("IAX", ["SQZ", "SQR", "OMZ", "CTL", "CTC"]),
    ("COZ", ["CLV", "SVE"]),
    ("PEZ", ["CSH", "PAL", "PAN", "PRA", "PEZ", "ENS", "MPM", "MPN", "PRB", "WKP", "PBA",
             "GIT", "TIP", "PNV", "SHS"]),
    ("CRA", ["CAD", "DUN", "CRE", "PCR", "SWM", "CRB", "SCD", "MUD"]),
    ("SLV", ["NEX", "LBA", "LBE", "NEP", "VLO", "LOR"]),
]
# Food-composition column -> nutrient column.
FAO_RENAME = [
    ("protein(g)", "Protein_mu"),
    ("calcium(mg)", "Calcium_mu"),
    ("iron(mg)", "Iron_mu"),
    ("zinc(mg)", "Zinc_mu"),
    ("selenium(mcg)", "Selenium_mu"),
    ("vitaminA(mcg)", "Vitamin_A_mu"),
    ("omega3(g)", "Omega_3_mu"),
]
# Pelagic groups whose median stands in for flying fish (FLY).
FLY_PROXIES = ["CLP", "RAX", "SDX"]

# Functional-group classifier: the three distinct variants written out in full
# (duplicate list entries removed; a code in no list gets NULL).
FISH_GROUP_VARIANTS = {
    # density-by-taxon chapter
    "taxon": [
        ("Molluscs", ["COZ", "CUX"]),
        ("Shrimps", ["PEZ"]),
        ("Other", ["MZZ"]),
        ("Crustaceans", ["SLV", "CRA"]),
        ("Cephalopods", ["OCZ", "IAX"]),
        ("Sharks and rays", ["SKH", "SRX"]),
        ("Large demersals", ["SNA", "GPX", "PWT", "GRX", "MUI", "BGX"]),
        ("Large pelagics", ["CGX", "TUN", "BEN", "LWX", "BAR", "SFA", "CBA", "DOX", "ECN", "DOS"]),
        ("Small demersals", ["YDX", "SPI", "EMP", "SUR", "TRI", "MOJ", "WRA", "BWH", "LGE", "MOB",
                             "MHL", "GOX", "THO", "IHX", "APO", "PUX", "DRZ", "DSF"]),
        ("Small pelagics", ["RAX", "SDX", "CJX", "CLP", "GZP", "FLY", "KYX", "MOO", "MUL", "MIL", "THF"]),
    ],
    # group-yield and top-taxon chapters
    "yield": [
        ("Molluscs", ["COZ"]),
        ("Shrimps", ["PEZ"]),
        ("Other", ["MZZ"]),
        ("Crustaceans", ["SLV", "CRA"]),
        ("Cephalopods", ["OCZ", "IAX"]),
        ("Sharks and rays", ["SKH", "SRX"]),
        ("Large demersals", ["SNA", "GPX", "PWT", "GRX", "MUI", "BGX"]),
        ("Large pelagics", ["CGX", "TUN", "BEN", "LWX", "BAR", "SFA", "CBA", "DOX", "ECN", "DOS"]),
        ("Small demersals", ["YDX", "SPI", "EMP", "SUR", "TRI", "MOJ", "WRA", "BWH", "LGE", "MOB",
                             "MHL", "GOX", "THO", "IHX", "APO", "PUX", "DRZ"]),
        ("Small pelagics", ["RAX", "SDX", "CJX", "CLP", "GZP", "FLY", "KYX", "MOO", "MUL", "DSF",
                            "MIL", "THF"]),
    ],
    # appendix chapter
    "appendix": [
        ("Molluscs", ["COZ"]),
        ("Shrimps", ["PEZ"]),
        ("Other", ["MZZ"]),
        ("Crustaceans", ["SLV", "CRA"]),
        ("Cephalopods", ["OCZ", "IAX"]),
        ("Sharks and rays", ["SKH", "SRX"]),
        ("Large demersals", ["SNA", "GPX", "PWT", "GRX", "MUI", "BGX"]),
        ("Large pelagics", ["CGX", "TUN", "BEN", "LWX", "BAR", "SFA", "CBA", "DOX", "ECN", "DOS"]),
        ("Small demersals", ["YDX", "SPI", "EMP", "SUR", "TRI", "MOJ", "WRA", "MOO", "BWH", "LGE",
                             "MOB", "MHL", "GOX", "THO", "IHX", "APO", "PUX", "DRZ", "DSF"]),
        ("Small pelagics", ["RAX", "SDX", "CJX", "CLP", "GZP", "FLY", "KYX", "MUL", "MIL", "THF"]),
    ],
}
INVERTEBRATE_GROUPS = ["Shrimps", "Molluscs", "Cephalopods", "Crustaceans"]
# Short labels of functional groups.
FISH_LABELS = [
    ("Small pelagics", "SP"),
    ("Large pelagics", "LP"),
    ("Small demersals", "SD"),
    ("Large demersals", "LD"),
    ("Sharks and rays", "SR"),
    ("Marine invertebrates", "MI"),
]
# Display names of nutrients after title-casing.
NUTRIENT_TITLES = [("Omega3", "Omega-3"), ("Vitamina", "Vitamin-A")]
# Axis value order of the three-axis flow table.
FLOW_LEVELS = [
    "Protein", "Omega-3", "Calcium", "Iron", "Vitamin-A", "Zinc", "Selenium",
    "Reef", "Pelagic", "FAD", "Beach", "Traditional FAD", "Mangrove", "Seagrass",
    "gill net", "seine net", "spear gun", "hand line", "long line", "manual collection",
    "beach seine", "trap", "cast net",
]
# Fixed taxa of the appendix affordability variant.
APPENDIX_TAXA = ["CLP", "GZP", "TUN", "SDX", "FLY", "CGX"]

# =============================================================================
# Our own stand-in choices for the driver tables (not study values)
# =============================================================================

# Brand#1 .. Brand#25 -> taxon code (covers every classifier edge case).
BRAND_TAXA = ["RAX", "SDX", "CLP", "FLY", "TUN", "CGX", "SNA", "GPX", "EMP", "SPI",
              "DSF", "MOO", "CUX", "SWX", "MZZ", "OCZ", "IAX", "COZ", "PEZ", "CRA",
              "SLV", "SKH", "BAR", "KYX", "MUL"]
# Raw food-composition codes cycled over suppliers (some fall outside every list).
FAO_RAW_CODES = [c for _, codes in FAO_GROUPS for c in codes] + ["XXX", "YYY", "ZZZ"]

HABITATS = [("1-URGENT", "Reef"), ("2-HIGH", "Deep"), ("3-MEDIUM", "FAD"),
            ("4-NOT SPECIFIED", "Traditional FAD"), ("5-LOW", "Beach")]
GEARS = [("BUILDING", "gill net"), ("AUTOMOBILE", "hand line"), ("MACHINERY", "spear gun"),
         ("HOUSEHOLD", "seine net"), ("FURNITURE", "long line")]
VESSELS = [("F", "Motor"), ("O", "Canoe"), ("P", "Sail")]


# ----------------------------------------------------------------------------- frames

def rdi_df(spark: SparkSession, share: float = 1.0) -> DataFrame:
    """RDI table, optionally scaled (``share=0.2`` for the 20 % scenario)."""
    df = spark.createDataFrame(RDI, "nutrient string, conv_factor double")
    if share != 1.0:
        df = df.withColumn("conv_factor", F.col("conv_factor") * F.lit(share))
    return df


def catch_groups_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATCH_GROUPS, "catch_name string, family string, interagency_code string")


def fish_group_df(spark: SparkSession, variant: str) -> DataFrame:
    rows = [(code, group) for group, codes in FISH_GROUP_VARIANTS[variant] for code in dict.fromkeys(codes)]
    return spark.createDataFrame(rows, "grouped_taxa string, fish_group string")


def brand_taxa_df(spark: SparkSession) -> DataFrame:
    rows = [(f"Brand#{i + 1}", code) for i, code in enumerate(BRAND_TAXA)]
    return spark.createDataFrame(rows, "p_brand string, grouped_taxa string")


def pairs_df(spark: SparkSession, pairs, key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(pairs), f"{key} string, {value} string")
