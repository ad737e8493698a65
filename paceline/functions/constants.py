"""Lookup tables and model constants the results depend on."""

# Circuit metadata (key: latitude, longitude, type, overtaking difficulty)
CIRCUITS = {
    "bahrain": (26.0325, 50.5106, "technical", 0.3),
    "jeddah": (21.6319, 39.1044, "street", 0.5),
    "albert_park": (-37.8497, 144.968, "street", 0.6),
    "suzuka": (34.8431, 136.541, "high_speed", 0.7),
    "shanghai": (31.3389, 121.22, "technical", 0.35),
    "miami": (25.9581, -80.2389, "street", 0.45),
    "imola": (44.3439, 11.7167, "technical", 0.65),
    "monaco": (43.7347, 7.4206, "street", 0.95),
    "montreal": (45.5, -73.5228, "street", 0.35),
    "barcelona": (41.57, 2.2611, "high_speed", 0.6),
    "spielberg": (47.2197, 14.7647, "high_speed", 0.3),
    "silverstone": (52.0786, -1.0169, "high_speed", 0.45),
    "hungaroring": (47.5789, 19.2486, "technical", 0.8),
    "spa": (50.4372, 5.9714, "high_speed", 0.25),
    "zandvoort": (52.3888, 4.5409, "technical", 0.75),
    "monza": (45.6156, 9.2811, "high_speed", 0.25),
    "baku": (40.3725, 49.8533, "street", 0.3),
    "singapore": (1.2914, 103.864, "street", 0.7),
    "cota": (30.1328, -97.6411, "technical", 0.35),
    "mexico_city": (19.4042, -99.0907, "technical", 0.4),
    "interlagos": (-23.7036, -46.6997, "technical", 0.3),
    "las_vegas": (36.1162, -115.174, "street", 0.35),
    "lusail": (25.49, 51.4542, "technical", 0.45),
    "yas_marina": (24.4672, 54.6031, "technical", 0.4),
}

# Feed circuit id -> metadata key where the two differ
CIRCUIT_ALIASES = {
    "villeneuve": "montreal",
    "catalunya": "barcelona",
    "red_bull_ring": "spielberg",
    "marina_bay": "singapore",
    "americas": "cota",
    "rodriguez": "mexico_city",
    "losail": "lusail",
}

# Circuit key -> race laps, lap length in km; others get DEFAULT_RACE_LENGTH
RACE_LENGTHS = {
    "albert_park": (58, 5.278),
    "bahrain": (57, 5.412),
    "jeddah": (50, 6.174),
    "suzuka": (53, 5.807),
    "shanghai": (56, 5.451),
    "miami": (57, 5.412),
    "imola": (63, 4.909),
    "monaco": (78, 3.337),
    "montreal": (70, 4.361),
    "barcelona": (66, 4.675),
    "silverstone": (52, 5.891),
    "spa": (44, 7.004),
    "monza": (53, 5.793),
    "singapore": (62, 4.940),
    "yas_marina": (58, 5.281),
}
DEFAULT_RACE_LENGTH = (58, 5.278)

# Nationality -> home circuits
HOME_CIRCUITS = {
    "British": ["silverstone"],
    "Dutch": ["zandvoort"],
    "Spanish": ["barcelona"],
    "Australian": ["albert_park"],
    "Mexican": ["mexico_city"],
    "Canadian": ["montreal"],
    "Monegasque": ["monaco"],
    "Japanese": ["suzuka"],
    "Chinese": ["shanghai"],
    "American": ["cota", "miami", "las_vegas"],
    "Italian": ["monza", "imola"],
    "Brazilian": ["interlagos"],
}

# codes
CIRCUIT_TYPES = {"street": 0, "technical": 1, "high_speed": 2}
COMPOUNDS = {"SOFT": 0, "MEDIUM": 1, "HARD": 2, "INTERMEDIATE": 3, "WET": 4}
WEATHER_BANDS = [(3, "dry"), (49, "cloudy"), (69, "rain"), (79, "snow"), (99, "storm")]
POSITION_PROBABILITY = [(1, 0.85), (2, 0.75), (3, 0.65), (5, 0.30), (8, 0.10), (12, 0.03)]
POSITION_PROBABILITY_REST = 0.01

# Feature defaults when an entrant has no data
FEATURE_DEFAULTS = {
    "grid_position": 20,
    "quali_q3_reached": 0,
    "driver_last3_avg_pos": 15.0,
    "driver_last5_podium_rate": 0.0,
    "driver_last5_avg_pos": 15.0,
    "driver_recent_dnf_rate": 0.0,
    "driver_circuit_avg_pos": 10.0,
    "driver_circuit_best_pos": 10,
    "driver_championship_pos": 20,
    "driver_championship_pts": 0.0,
    "constructor_championship_pos": 10,
    "constructor_championship_pts": 0.0,
    "constructor_reliability": 0.9,
    "teammate_quali_gap": 0.0,
    "circuit_type": 1,
    "circuit_overtake_difficulty": 0.5,
    "home_race": 0,
    "season_progress": 0.5,
}

# Survival weights (season, recent, circuit)
SURVIVAL_WEIGHTS = (0.5, 0.3, 0.2)

# Live model
DEFAULT_PRIOR = 0.05
DEFAULT_GAP = 999.0
LAP_GAP_SECONDS = 90.0
DEFAULT_POSITION = 20
DEFAULT_TOTAL_LAPS = 50
ALPHA_GREEN, ALPHA_SAFETY_CAR = 0.02, 0.005
BETA_SOFT, BETA_MEDIUM, BETA_HARD = 0.015, 0.01, 0.005
SAFETY_CAR_WEAR = 2.0
PODIUM_BONUS = 1.2
BURN_IN_RATE = 3.0
PROBABILITY_CAP = 0.99
PROBABILITY_FLOOR = 0.01
BLEND_TEMPERATURE = 10.0
TYRE_LIFE = 30

# Podium ranking
RANK_TEMPERATURE = 3.0
RANK_DEFAULT_POSITION = 10.0
CONFIDENCE_THRESHOLD = 0.05

# Race card
BASE_LAP_SECONDS, LAP_SECONDS_PER_PLACE = 82.0, 0.3
DNF_BANDS = [(0.95, "Low"), (0.85, "Moderate")]
DNF_BAND_REST = "Elevated"
CARD_CONFIDENCE = 0.05
DRIFT_TOLERANCE = 0.10

# Matrix columns
FEATURES = [
    "grid_position",
    "quali_gap_to_pole",
    "quali_q3_reached",
    "quali_consistency",
    "driver_last3_avg_pos",
    "driver_last5_podium_rate",
    "driver_last5_avg_pos",
    "driver_recent_dnf_rate",
    "driver_circuit_avg_pos",
    "driver_circuit_best_pos",
    "driver_championship_pos",
    "driver_championship_pts",
    "constructor_championship_pos",
    "constructor_championship_pts",
    "constructor_reliability",
    "constructor_season_reliability",
    "constructor_circuit_reliability",
    "constructor_survival_prob",
    "teammate_quali_gap",
    "circuit_type",
    "circuit_overtake_difficulty",
    "home_race",
    "season_progress",
]
