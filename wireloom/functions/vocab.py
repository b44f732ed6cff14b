"""Controlled vocabularies, word lists, weights and limits.

Everything in this file is a fixed value: results are only right when these
lists, tables and numbers are exactly these. Code elsewhere refers to them by
name; nothing here computes.
"""

from __future__ import annotations

# --- fixed values: enumerations ------------------------------------------------
TOPICS = ("macro_econ", "central_banks", "equities", "credit", "rates", "fx", "commodities", "crypto",
          "war_security", "geopolitics", "company_specific", "other")
SENTIMENTS = ("positive", "negative", "neutral", "mixed", "unknown")
BREAKING_WINDOWS = ("15m", "1h", "4h", "none")
PRIORITIES = ("none", "low", "medium", "high")
EVENT_TYPES = ("policy", "conflict", "logistics", "production", "sanctions", "spending", "weather", "market",
               "company", "other")
DIRECTIONS = ("stress", "easing", "neutral")
ITEM_SOURCES = ("observed", "inferred")
ROUTES = ("store_only", "index_only", "deep_enrich")
TAG_FAMILIES = ("countries", "organizations", "companies", "commodities", "sectors", "event_mechanisms", "policy",
                "conflict", "logistics", "production", "sanctions", "spending", "weather", "strategic",
                "directionality")
RELATION_ENTITIES = ("country", "organization", "company", "commodity", "sector", "state", "policy", "conflict",
                     "logistics", "production", "sanctions", "spending", "weather")
RELATION_TYPES = ("conflict_with", "restricts_export_of", "curtails", "input_to", "increases_spending_on",
                  "sanctions", "disrupts_logistics_of", "expands_production_of", "supports", "contradicts")
TAG_FAMILY_ALIASES = {
    "country": "countries", "organization": "organizations", "org": "organizations", "orgs": "organizations",
    "institution": "organizations", "agency": "organizations", "company": "companies",
    "commodity": "commodities", "sector": "sectors", "event_mechanism": "event_mechanisms",
    "mechanism": "event_mechanisms",
}
RELATION_ENTITY_ALIASES = {"org": "organization", "institution": "organization", "agency": "organization"}
PLACEHOLDERS = ("multiple countries", "multiple country", "various countries", "several countries",
                "multiple entities", "various entities", "unknown", "n/a", "na", "none", "null", "not specified",
                "tbd")
TOPIC_EVENT_TYPE = {
    "macro_econ": "market", "central_banks": "policy", "equities": "market", "credit": "market",
    "rates": "market", "fx": "market", "commodities": "production", "crypto": "market",
    "war_security": "conflict", "geopolitics": "policy", "company_specific": "company", "other": "other",
}
TOPIC_LABELS = {
    "macro_econ": "Macro Econ", "central_banks": "Central Banks", "equities": "Equities", "credit": "Credit",
    "rates": "Rates", "fx": "FX", "commodities": "Commodities", "crypto": "Crypto",
    "war_security": "War / Security", "geopolitics": "Geopolitics", "company_specific": "Company Specific",
    "other": "Other",
}

# --- fixed values: bulletin text normalisation (applied in this order) ----------
LEADING_MARKER_PATTERN = (
    "(?iU)^(?:(?:\\*+\\s*)?(?:⚠️|\U0001F6A8|BREAKING:?|ALERT:?|URGENT:?|\\[BREAKING\\])\\s*)+")
DATELINE_PATTERN = "(?iU)^[A-Z][A-Z .'-]{1,40}\\s*\\((?:AP|REUTERS|AFP|BLOOMBERG)\\)\\s*[—:-]\\s*"
AGENCY_SUFFIX_PATTERN = "(?iU)\\s*[-–—]\\s*(?:AP|REUTERS|AFP|AXIOS|BLOOMBERG)\\s*$"
REPEATED_PUNCT_PATTERN = "([!?.,:;])\\1+"

# --- fixed values: rule-based extraction -----------------------------------------
TOPIC_HINTS = (
    ("macro_econ", ("cpi", "ppi", "gdp", "inflation", "payroll", "nfp", "pce", "unemployment", "retail sales")),
    ("central_banks", ("fed", "fomc", "ecb", "boj", "boe", "rate decision", "hike", "cut", "minutes")),
    ("credit", ("spread", "cds", "high yield", "investment grade", "default", "distressed", "tranche")),
    ("rates", ("ust", "treasury", "yields", "bps", "bp", "curve", "2y", "10y", "30y")),
    ("fx", ("usd", "eur", "jpy", "gbp", "fx", "dxy")),
    ("commodities", ("oil", "brent", "wti", "gold", "silver", "copper", "gas", "opec")),
    ("crypto", ("btc", "bitcoin", "eth", "ethereum", "crypto", "stablecoin")),
    ("war_security", ("pentagon", "nato", "strike", "attack", "missile", "defense", "troops")),
    ("geopolitics", ("sanctions", "diplomacy", "election", "border", "tariff", "embargo")),
)
TICKER_PATTERN = "(?U)\\b[A-Z]{1,5}\\b"
NUMBER_PATTERN = "(?iU)(?<!\\w)(\\d+(?:\\.\\d+)?)(?:\\s?)(bp|bps|%|bn|m|mm|b|k)?\\b"

# --- fixed values: canonical names --------------------------------------------------
COUNTRY_ALIASES = {
    "us": "United States", "u.s.": "United States", "u.s": "United States", "usa": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "u.k": "United Kingdom",
    "uae": "United Arab Emirates", "eu": "European Union",
}
ACRONYMS = ("AP", "BOE", "ECB", "EU", "FED", "FOMC", "IAEA", "IMF", "NATO", "NIOC", "OPEC", "RBNZ", "UN", "UK", "US")
SMALL_WORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to")
INSTITUTION_MARKERS = ("agency", "authority", "bank of", "central bank", "council", "department",
                       "federal reserve", "government", "iaea", "ministry", "nato", "office", "pentagon",
                       "reserve bank", "treasury", "united nations")
KNOWN_COMPANIES = ("amazon", "coinbase", "fedex", "google", "kalshi")
STRESS_RELATIONS = ("conflict_with", "curtails", "disrupts_logistics_of", "increases_spending_on",
                    "restricts_export_of", "sanctions")
EASING_RELATIONS = ("contradicts", "expands_production_of", "supports")
DIRECTION_TAG_FAMILIES = ("conflict", "event_mechanisms", "logistics", "policy", "production", "sanctions",
                          "spending", "strategic", "weather")
STRESS_SUMMARY_WORDS = ("attack", "conflict", "curtail", "disrupt", "escalat", "halt", "restrict", "sanction",
                        "shortage", "strike")
EASING_SUMMARY_WORDS = ("ceasefire", "de-escalat", "expand", "lift", "resume", "supports")
MAX_RELATIONS = 3
FINGERPRINT_PREFIX = "v2"
CANONICALISER_VERSION = "canon_v3"
MISSING = "~"
HIGH_RISK_WORDS = ("killing", "killed", "assassination", "death of", "strike", "attack", "attacked", "targeting",
                   "casualties", "injured", "wounded", "dead", "invasion", "military escalation",
                   "direct strike", "major incident", "launched", "missile", "missiles")
ATTRIBUTION_WORDS = ("according to", "said", "says", "stated", "warned", "warns", "reported", "reportedly",
                     "claims", "claimed", "responded to reports")
GENERIC_SOURCES = ("market news feed", "news feed", "wire", "wire feed", "market wire", "telegram feed")
ACTION_CLASSES = (
    ("diplomatic", ("ceasefire", "talk", "negotiat", "diplom", "meeting", "summit", "agreement")),
    ("operational", ("strike", "attack", "missile", "drone", "shelling", "airstrike", "troops")),
    ("threat_response", ("warn", "threat", "retaliat", "respond", "response")),
    ("policy_restriction", ("sanction", "tariff", "export control", "embargo")),
    ("supply_disruption", ("supply", "shipment", "pipeline", "loading", "halt", "disruption")),
    ("market_macro", ("rate", "yield", "spread", "fx", "inflation", "gdp", "cpi")),
    ("legal_regulatory", ("probe", "investigation", "lawsuit", "charged", "regulator")),
)

# --- fixed values: impact calibration ---------------------------------------------------
TOPIC_RELEVANCE = {
    "central_banks": 30, "macro_econ": 28, "rates": 24, "credit": 24, "fx": 22, "commodities": 22,
    "war_security": 20, "geopolitics": 18, "equities": 18, "crypto": 16, "company_specific": 14, "other": 8,
}
URGENCY = {"15m": 10, "1h": 7, "4h": 4, "none": 1}
TRANSMISSION_WORDS = ("yield", "yields", "spread", "spreads", "rate", "rates", "funding", "liquidity", "inflation",
                      "growth", "recession", "credit", "oil", "gas", "brent", "wti", "currency", "fx", "usd",
                      "eur", "jpy", "equity", "stocks", "bond", "bonds", "commodity", "commodities", "exports",
                      "imports", "sanction", "capital control")
MAGNITUDE_WORDS = ("default", "collapse", "failure", "emergency", "surprise", "recession", "sanctions", "halt",
                   "cut production", "hike", "cut")
TRANSMISSION_TOPICS = ("central_banks", "macro_econ", "rates", "credit", "fx", "commodities")
STRATEGIC_TOPICS = ("war_security", "geopolitics", "commodities")
SHOCKS = (
    ("central_bank_rate_change", ("rate hike", "rate cut", "hike rates", "cut rates", "policy rate", "fomc",
                                  "ecb", "boj", "boe")),
    ("sovereign_default", ("sovereign default", "government default", "debt default", "missed coupon")),
    ("major_bank_failure", ("bank failure", "bank collapse", "insolvency", "bank run")),
    ("war_outbreak", ("war outbreak", "invaded", "invasion", "major offensive", "missile barrage", "airstrike")),
    ("large_scale_sanctions", ("sweeping sanctions", "broad sanctions", "large-scale sanctions",
                               "export controls")),
    ("major_commodity_disruption", ("supply disruption", "pipeline shutdown", "strait of hormuz",
                                    "production halt", "major opec cut")),
    ("systemic_financial_crisis", ("systemic crisis", "financial crisis", "credit crunch", "liquidity crisis")),
    ("major_macroeconomic_surprise", ("major surprise", "significantly above expectations",
                                      "significantly below expectations", "cpi surprise", "jobs surprise",
                                      "gdp surprise")),
)
PERCENT_BPS_PATTERN = "\\b\\d+(?:\\.\\d+)?\\s*(%|bp|bps)\\b"

# --- fixed values: triage ------------------------------------------------------------------
REACTION_WORDS = ("condemn", "concern", "urge", "calls for", "unacceptable", "warns", "responds")
OPERATIONAL_WORDS = ("strike", "attacked", "launched", "killed", "injured", "casualties", "missile", "troops",
                     "explosion")
LOCAL_WORDS = ("police", "incident", "injured", "city", "county", "sheriff", "public safety")
AUTHORITY_WORDS = ("police", "ministry", "official", "military", "agency", "spokesperson")
COMMENTARY_WORDS = ("commentary", "analyst", "opinion", "urges", "condemns", "concerned")
CONFLICT_PLACES = ("missile", "strike", "military", "airstrike", "drone", "cross-border", "invasion", "army",
                   "navy", "tehran", "israel", "iran", "ukraine", "russia")
LOCAL_AUTHORITY_WORDS = ("police", "sheriff", "public safety")
LOCAL_HARM_WORDS = ("incident", "injured", "wounded", "casualt")
LOCAL_AREA_WORDS = (" city ", " county ", " state ")
LOCAL_PLACE_PATTERN = "\\b[A-Z][a-z]+,\\s*[A-Z]{2}\\b"
DUPLICATE_MARKERS = ("triage:repeat_downgrade", "triage:burst_cap_update", "triage:burst_cap_monitor",
                     "triage:soft_related_downgrade")
DESTINATIONS = {
    "macro_econ": "macro_events", "central_banks": "macro_events", "equities": "stocks_events",
    "credit": "credit_events", "rates": "macro_events", "fx": "macro_events", "commodities": "macro_events",
    "crypto": "crypto_events", "war_security": "war_security_events", "geopolitics": "war_security_events",
    "company_specific": "stocks_events", "other": "other_events",
}
PRIORITY_FLOORS = ((80.0, "high"), (60.0, "medium"), (30.0, "low"), (0.0, "none"))
EVIDENCE_TOPICS = ("macro_econ", "war_security", "credit")

# --- fixed values: themes ---------------------------------------------------------------------
ENERGY_MARKERS = ("gas", "lng", "natural gas", "power", "electricity", "diesel", "oil", "crude", "brent", "wti",
                  "feedstock")
SUPPLY_MARKERS = ("outage", "shutdown", "curtail", "restriction", "disruption", "tightening", "export ban")
DOWNSTREAM_MARKERS = ("cost", "input", "margin", "capacity", "fertilizer", "ammonia", "urea", "agri")
ARCHETYPES = (
    ("supply_disruption", ("disruption", "shutdown", "halt", "shortage", "tightening")),
    ("outage_restart", ("outage", "restart", "resume", "reopen")),
    ("regulatory_change", ("regulation", "policy", "regulatory", "mandate")),
    ("sanctions_escalation", ("sanction", "embargo", "asset freeze")),
    ("logistics_disruption", ("shipping", "freight", "logistics", "port", "transit", "route")),
    ("input_price_shock", ("price shock", "price spike", "surge", "jump", "record high", "cost jump")),
    ("export_restriction", ("export ban", "export curb", "quota", "export restriction")),
    ("weather_shock", ("storm", "freeze", "drought", "heatwave", "weather")),
    ("capacity_expansion_closure", ("capacity", "closure", "shutdown", "curtailment", "utilization")),
    ("guidance_or_policy_signal", ("guidance", "outlook", "expects", "forecast", "policy signal")),
)
STRESS_WORDS = ("surge", "spike", "jump", "shortage", "tightening", "shutdown", "curtail", "disruption",
                "restriction")
EASING_WORDS = ("restart", "resume", "reopen", "normalization", "price falls", "price drop", "capacity returns")
SUPPLY_SHAPE_ARCHETYPES = ("supply_disruption", "logistics_disruption", "capacity_expansion_closure",
                           "export_restriction", "outage_restart")
TRANSMISSION_PATTERNS = ("input_cost_pass_through", "supply_tightening", "capacity_curtailment",
                         "trade_flow_rerouting", "substitution_effect", "margin_compression_expansion",
                         "geographic_bottleneck")
LENSES = (
    {"key": "input_cost_pass_through", "pattern": "input_cost_pass_through",
     "archetypes": ("input_price_shock", "supply_disruption", "sanctions_escalation", "logistics_disruption"),
     "signals": ("energy_price_or_cost_stress", "supply_side_friction"),
     "recent_spike": 4.0, "persistent_buildup": 0.0, "contradiction": 0.0},
    {"key": "capacity_curtailment", "pattern": "capacity_curtailment",
     "archetypes": ("capacity_expansion_closure", "supply_disruption", "outage_restart", "export_restriction"),
     "signals": ("capacity_or_utilization_stress", "persistent_supply_tightening"),
     "recent_spike": 0.0, "persistent_buildup": 5.0, "contradiction": -4.0},
)
CARD_GATES = {"strength": 45.0, "confidence": 50.0, "priority": 55.0}
CARD_LOOKBACK_DAYS = {"daily": 7, "weekly": 28}
CARD_CHANGE = {"confidence": 8.0, "priority": 8.0, "overlap": 0.75}
OPPORTUNITY_TEXT = {
    "input_cost_pass_through": (
        "Look for downstream agri-input margin pressure where feedstock costs stay elevated.",
        "Monitor relative winners with stronger pass-through pricing power."),
    "capacity_curtailment": (
        "Watch for producers exposed to energy-cost-driven utilization cuts.",
        "Prioritize setups where tightening supply can support pricing downstream."),
}
RISK_TEXT = {
    "input_cost_pass_through": (
        "Energy retracement can soften pass-through pressure quickly.",
        "Policy intervention on input subsidies can reduce pricing transmission."),
    "capacity_curtailment": (
        "Rapid restart/outage resolution can invalidate curtailment risk.",
        "Demand softness can offset supply tightening effects."),
}
INVALIDATION_TEXT = {
    "input_cost_pass_through": (
        "Energy input benchmarks normalize materially for multiple consecutive runs.",
        "Contradictory evidence dominates supporting evidence in the next run window."),
    "capacity_curtailment": (
        "Capacity normalization/restart evidence outpaces disruption signals.",
        "Supply-side stress markers fade below activation thresholds."),
}

# --- fixed values: opportunity topics and drivers ---------------------------------------------
MEMO_TOPICS = ("natural_gas", "lng", "oil", "fertilizers", "grains", "power", "shipping", "carbon", "coal")
TOPIC_KEYWORDS = {
    "natural_gas": ("natural gas", "gas", "henry hub", "ttf", "pipeline gas"),
    "lng": ("lng", "liquefied natural gas", "regasification"),
    "oil": ("oil", "crude", "brent", "wti", "diesel", "naphtha"),
    "fertilizers": ("fertilizer", "fertiliser", "ammonia", "urea", "potash", "dap", "map"),
    "grains": ("grain", "grains", "wheat", "corn", "maize", "soy", "soybean", "barley", "rice"),
    "power": ("power", "electricity", "grid", "generation", "utility", "baseload"),
    "shipping": ("shipping", "freight", "vessel", "tanker", "port", "transit", "route", "logistics"),
    "carbon": ("carbon", "co2", "emissions", "allowance", "ets", "cbam", "offset"),
    "coal": ("coal", "thermal coal", "coking coal"),
}
DRIVERS = (
    ("supply_disruption", ("disruption", "outage", "shutdown", "restriction", "curtail")),
    ("demand_acceleration", ("demand", "consumption", "import growth", "demand surge")),
    ("inventory_shift", ("inventory", "stockpile", "storage", "draw", "build")),
    ("policy_change", ("policy", "regulation", "sanction", "tariff", "quota", "mandate")),
    ("trade_flow_repricing", ("shipping", "freight", "route", "spread", "repricing", "arbitrage")),
    ("weather_shock", ("weather", "storm", "freeze", "drought", "heatwave")),
    ("input_cost_pressure", ("price", "cost", "feedstock", "margin", "input cost")),
)
DRIVER_HINTS = (
    ("supply_disruption", ("disruption", "outage", "shutdown", "restriction")),
    ("demand_acceleration", ("demand", "import growth", "consumption")),
    ("inventory_shift", ("inventory", "stockpile", "storage", "draw")),
    ("policy_change", ("policy", "regulation", "sanction", "tariff", "quota")),
    ("trade_flow_repricing", ("shipping", "freight", "route", "spread", "repricing")),
    ("weather_shock", ("weather", "storm", "freeze", "drought", "heatwave")),
)
FALLBACK_DRIVER = "input_cost_pressure"
ACTIONABLE_RELATIONS = ("restricts_export_of", "curtails", "disrupts_logistics_of", "supports",
                        "expands_production_of")
CONFIRMABLE_RELATIONS = ACTIONABLE_RELATIONS + ("sanctions",)
TOPIC_THRESHOLD = 0.58

# --- fixed values: memo text audit ---------------------------------------------------------------
MEMO_TEXT_SECTIONS = ("title", "core_thesis_one_liner", "opportunity_target", "market_setup", "background",
                      "primary_driver", "why_now", "why_this_is_an_opportunity", "trade_expression", "conclusion")
MEMO_LIST_SECTIONS = {"supporting_developments": (2, 4), "quantified_evidence_points": (2, 20), "risks": (2, 20),
                      "invalidation_triggers": (2, 20), "watchpoints": (2, 20)}
MEMO_TRACED_SECTIONS = ("core_thesis_one_liner", "market_setup", "background", "primary_driver", "why_now",
                        "why_this_is_an_opportunity", "trade_expression", "conclusion")
MEMO_UNTRACED_SECTIONS = ("title",)
GENERIC_TARGETS = ("shipping industry", "energy markets", "commodity sector", "commodities sector",
                   "energy sector", "global markets")
TARGET_WORDS = ("spread", "basis", "curve", "corridor", "route", "benchmark", "ttf", "henry hub", "brent", "wti",
                "freight", "producer", "import", "export", "class", "bucket", "equities", "futures", "options",
                "volatility")
THESIS_DIRECTION_WORDS = ("repricing", "tightening", "widening", "upside", "downside", "overweight",
                          "underweight", "long", "short", "premium", "discount", "bullish", "bearish")
THESIS_REASON_WORDS = ("driven by", "because", "as", "due to", "from", "on")
TIMING_WORDS = ("now", "recent", "within", "window", "this week", "last", "currently", "immediate", "accelerat")
TRADE_WORDS = ("futures", "options", "spread", "basis", "curve", "pair trade", "overweight", "underweight",
               "long", "short", "hedge", "exposure", "freight", "benchmark", "volatility")
VAGUE_TRADE_PHRASES = ("monitor developments", "consider diversifying", "proactive approach",
                       "investors may benefit", "keep watching")
LOGIC_WORDS = ("mispriced", "underappreciated", "repricing", "risk premium", "spread", "transmission",
               "valuation", "margin", "earnings", "cash flow", "asymmetry", "discount", "financially")
FILLER_PHRASES = ("monitor developments", "stay informed", "various factors", "market uncertainty",
                  "dynamic environment")
MUTATING_SQL_WORDS = ("insert", "update", "delete", "drop", "alter", "create", "replace", "pragma", "attach", "detach",
                      "vacuum", "reindex", "analyze", "begin", "commit", "rollback", "truncate", "lock", "grant",
                      "revoke", "copy", "call", "do", "merge")
