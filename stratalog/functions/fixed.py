"""Word lists, lookup tables and limits that results depend on.

Fixed values - they are data, stated once here and used everywhere else.
"""

# tokens that mean "no value", by vocabulary
TABLE_NULLS = ["", "null", "none", "nan", "na", "n/a"]
MODEL_NULLS = ["", "nan", "none", "null", "na", "n/a", "invalid"]
SOURCE_NULLS = ["", "null"]
DISPLAY_NULLS = ["", "ASPECTRAL", "NULL", "INVALID"]
NOT_ROCK = [
    "", "NAN", "NONE", "INVALID", "ASPECTRAL", "NOTAROK", "NOT A ROCK", "WHITEMARKER",
    "WHITE MARKER", "WOOD", "VEGETATION", "NULL", "NA", "N/A",
]

# mineral species -> mineral group
SPECIES_GROUP = {
    "Chlorite": "CHLORITE",
    "Kaolinite": "KAOLIN",
    "Dickite": "KAOLIN",
    "Nacrite": "KAOLIN",
    "Halloysite": "KAOLIN",
    "Muscovite": "WHITE-MICA",
    "Paragonite": "WHITE-MICA",
    "Illite": "WHITE-MICA",
    "Phengite": "WHITE-MICA",
    "Biotite": "DARK-MICA",
    "Phlogopite": "DARK-MICA",
    "Calcite": "CARBONATE",
    "Dolomite": "CARBONATE",
    "Ankerite": "CARBONATE",
    "Siderite": "CARBONATE",
    "Magnesite": "CARBONATE",
    "Gypsum": "SULPHATE",
    "Alunite": "SULPHATE",
    "Jarosite": "SULPHATE",
    "Epidote": "EPIDOTE",
    "Zoisite": "EPIDOTE",
    "Clinozoisite": "EPIDOTE",
    "Hornblende": "AMPHIBOLE",
    "Actinolite": "AMPHIBOLE",
    "Tremolite": "AMPHIBOLE",
    "Riebeckite": "AMPHIBOLE",
    "Talc": "OTHER-MGOH",
    "Serpentine": "SERPENTINE",
    "Montmorillonite": "SMECTITE",
    "Nontronite": "SMECTITE",
    "Saponite": "SMECTITE",
    "Tourmaline": "TOURMALINE",
    "Rubellite": "TOURMALINE",
    "Prehnite": "OTHER-MGOH",
    "Pyrophyllite": "OTHER",
    "Topaz": "OTHER",
    "Diaspore": "OTHER",
    "Gibbsite": "OTHER",
}

# log family suffix -> (algorithm, region, variant)
LOG_FAMILIES = {
    "sTSAV": ("TSA", "VNIR", "s"),
    "uTSAV": ("TSA", "VNIR", "u"),
    "sTSAS": ("TSA", "SWIR", "s"),
    "uTSAS": ("TSA", "SWIR", "u"),
    "sjCLST": ("jCLST", "TIR", "s"),
    "ujCLST": ("jCLST", "TIR", "u"),
    "sTSAT": ("TSA", "TIR", "s"),
    "uTSAT": ("TSA", "TIR", "u"),
}

# log name prefix -> (metric key, value type)
LOG_METRICS = {
    "Min": ("mineral_name", "text"),
    "Grp": ("mineral_group", "text"),
    "Wt": ("mineral_weight", "numeric"),
    "Error": ("fit_error", "numeric"),
    "SNR": ("snr", "numeric"),
    "NIL_Stat": ("nil_stat", "numeric"),
    "Unbound_Water": ("unbound_water", "numeric"),
    "Bound_Water": ("bound_water", "numeric"),
    "AspRat": ("asp_rat", "numeric"),
    "TNorm": ("t_norm", "numeric"),
}

# role -> folded column names, best first
ROLE_COLUMNS = {
    "group": ["grp1stsas", "grp1utsas", "grp1stsat", "grp1utsat", "grp1stsav", "grp1utsav"],
    "mineral": ["min1stsas", "min1utsas", "min1stsat", "min1utsat", "min1stsav", "min1utsav"],
    "weight": ["wt1stsas", "wt1utsas", "wt1stsat", "wt1utsat", "wt1stsav", "wt1utsav"],
    "error": ["errorstsas", "errorutsas", "errorstsat", "errorutsat", "error"],
    "snr": ["snrstsas", "snrutsas", "snr"],
}

# confidence rules: name, input it needs, threshold, reason
COVERAGE_RULE = ("coverage", None, 0.5, "over half this metre had no usable reading")
AGREEMENT_RULE = ("agreement", None, 0.6, "the readings within this metre disagree with each other")
FIT_RULE = ("fit", "error", 400.0, "the spectrum was a poor fit to any known mineral")
SIGNAL_RULE = ("signal", "snr", 200.0, "weak signal (low signal-to-noise)")
DOMINANCE_RULE = ("dominance", "weight", 0.4, "no single mineral clearly dominates")

# classification channels compared with each other
CHANNEL_FEATURES = ["Min1", "Min2", "Min3", "Grp1", "Grp2", "Grp3"]
CHANNEL_TYPES = ["sTSAS", "uTSAS", "sjCLST", "ujCLST", "sTSAV"]
REDUNDANT_PAIRS = [("sTSAS", "uTSAS"), ("sjCLST", "ujCLST")]

# column name prefixes that never take part in scoring
UNSCORED_PREFIXES = ["date", "holeid", "tray", "secsamp", "subpix"]

# header names under which a hole-id list may keep its ids
ID_HEADERS = ["hole_id", "holeid", "hole", "id", "borehole_id"]

# reserved file names
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)]

# package documents and the type each must have at the top
PACKAGE_DOCUMENTS = {
    "borehole.json": "object",
    "datasets.json": "array",
    "package_manifest.json": "object",
    "logs_scalar.json": "array",
    "scalar_manifest.json": "array",
    "logs_spectral.json": "array",
    "spectral_manifest.json": "array",
    "logs_profilometer.json": "array",
    "profilometer_manifest.json": "array",
    "logs_image.json": "array",
    "image_logs_by_dataset.json": "array",
    "images_manifest.json": "object",
    "tray_depths.json": "object",
}

EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_KM_ROUND = 6371.0
SAME_HOLE_KM = 0.5
METRES_PER_DEGREE_LAT = 110540.0
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122 namespace for URLs
FLOAT32_MIN = -3.4028234663852886e38
SCORE_CLIP = 25.0
