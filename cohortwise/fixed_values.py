"""Column lists, labels and edges that decide what a result looks like.

They are the contract with existing consumers of the reports and are stated as they are.
"""

# --- fixed values: risk bands ---------------------------------------------------------------
RISK_BAND_EDGES = (0.2, 0.4, 0.6, 0.8)
RISK_BAND_LABELS = ("Muy Bajo", "Bajo", "Moderado", "Alto", "Muy Alto")

# --- fixed values: report bins and labels ---------------------------------------------------
AGE_EDGES = (0, 18, 30, 45, 60, 75, 120)
AGE_LABELS = ("0-18", "19-30", "31-45", "46-60", "61-75", "76+")
TEMPERATURE_EDGES = (10, 15, 20, 25, 30)
TEMPERATURE_UNIT = "°C"
PRECIPITATION_EDGES = (500, 1000, 1500, 2000, 2500)
PRECIPITATION_UNIT = "mm"
RISK_EDGES = (0.2, 0.4, 0.6, 0.8)
TARGET_EDGES = (0.0, 0.3, 0.5, 0.7, 0.9, 1.1)
PANDEMIC_YEARS = (2020, 2021, 2022)
EDUCATION_LABELS = {
    1: "Ninguno",
    2: "Preescolar",
    3: "Primaria",
    4: "Secundaria",
    5: "Media",
    6: "Normal",
    7: "Técnico",
    8: "Técnologo",
    9: "Universitario",
    10: "Especialización",
}
UNKNOWN_LABEL = "Desconocido"
ACCESS_LABELS = {1: "Con acceso", 0: "Sin acceso"}
AREA_LABELS = {"U": "Urbano", "R": "Rural"}
SMOKER_LABELS = ("Fumador", "No Fumador")
DIABETES_LABELS = ("Diabético", "No Diabético")

# --- fixed values: columns ------------------------------------------------------------------
GEO_KEYS = ("department", "municipality")
INFRASTRUCTURE_COLUMNS = ("has_electricity", "has_water_supply", "has_gas", "has_internet")
NUMERIC_FEATURES = (
    "age", "bmi", "heart_rate", "total_cholesterol", "glucose",
    "is_smoker", "bpm_meds", "diabetes",
    "has_electricity", "has_water_supply", "has_gas", "has_internet", "family_history",
    "diagnosis_year", "diagnosis_month", "days_since_diagnosis", "pandemic_period",
)
CATEGORICAL_FEATURES = (
    "department", "municipality", "sex", "marital_status", "rural_area",
    "education_level", "socioeconomic_status", "occupation", "ethnicity",
    "diagnosis_trimester",
)
CLIMATE_FEATURE = "climate_classification"
POPULATION_KEYS = (
    "department", "municipality", "rural_area", "socioeconomic_status", "ethnicity",
    "occupation", "education_level", "climate_classification",
)
POPULATION_MEANS = (
    "age", "bmi", "total_cholesterol", "is_smoker", "family_history",
    "has_electricity", "has_water_supply", "has_sewage", "has_gas", "has_internet",
    "risk_score",
)
POPULATION_GEOGRAPHY = (
    "latitude", "longitude", "average_altitude", "average_temperature",
    "annual_precipitation", "estimated_population", "literacy_rate", "poverty_rate",
)
POPULATION_CATEGORICAL = (
    "rural_area", "socioeconomic_status", "ethnicity",
    "occupation", "education_level", "climate_classification",
)

# --- fixed values: feature groups, first match in this order wins ---------------------------
GEO_FEATURE_GROUP = "Environmental/Geographical"
OTHER_FEATURE_GROUP = "Others"
FEATURE_GROUPS = {
    "Medical_Factors": (
        "age", "bmi", "heart_rate", "total_cholesterol", "glucose",
        "is_smoker", "family_history", "diabetes", "bpm_meds",
    ),
    "Social_Conditions": (
        "marital_status", "occupation", "education_level", "socioeconomic_status",
    ),
    "Infrastructure": (
        "has_electricity", "has_water_supply", "has_sewage", "has_gas",
        "has_internet", "rural_area",
    ),
    "Environmental/Geographical": (
        "department", "municipality", "latitude", "longitude",
        "average_altitude", "average_temperature", "annual_precipitation",
        "climate_classification",
    ),
    "Other_Demographic": (
        "sex", "ethnicity", "diagnosis_year", "diagnosis_month",
        "days_since_diagnosis", "pandemic_period",
    ),
}

# --- fixed values: defaults -----------------------------------------------------------------
MIN_PATIENTS = 10
TOP_FACTORS = 5
DEFAULT_PATIENT_COLUMNS = {
    "risk_score": 0.0,
    "cardiovascular_risk": 0,
    "diagnosis_date": "2024-01-01",
}
GEO_FEATURE_PREFIXES = ("department_", "municipality_")
# Text that a CSV reader takes for a missing value.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
