"""Fixed values that results must agree on: regions, groups, limits, labels, colours, patterns."""

# fixed values: region ids and the order in which a feature lists them
REGION_IDS = ["boston", "ma", "ct", "ri", "nh", "vt", "me", "new-england"]
STATE_IDS = ["ct", "me", "ma", "nh", "ri", "vt"]
REGION_LIST_ORDER = ["ct", "ma", "me", "nh", "ri", "vt", "boston"]

# fixed values: region boxes (south, west, north, east)
REGION_BOXES = {
    "boston": (42.15, -71.25, 42.55, -70.65),
    "ma": (41.15, -73.65, 43.05, -69.75),
    "ct": (40.85, -73.8, 42.15, -71.7),
    "ri": (41.05, -71.95, 42.1, -70.95),
    "nh": (42.65, -72.7, 45.35, -70.55),
    "vt": (42.65, -73.55, 45.1, -71.35),
    "me": (42.8, -71.2, 47.65, -66.0),
    "new-england": (40.8, -74.0, 47.7, -66.0),
}

# fixed values: probe circles per region (lat, lng, radius in nautical miles)
PROBES = {
    "boston": [(42.36, -71.01, 60)],
    "ma": [(42.18, -71.8, 145)],
    "ct": [(41.6, -72.7, 95)],
    "ri": [(41.68, -71.5, 70)],
    "nh": [(43.85, -71.55, 125)],
    "vt": [(44.05, -72.7, 125)],
    "me": [(44.1, -69.9, 160), (46.1, -68.4, 150)],
    "new-england": [(41.75, -72.5, 120), (42.8, -71.3, 125), (44.25, -72.0, 150), (45.5, -68.8, 180)],
}
KM_PER_NAUTICAL_MILE = 1.852

# fixed values: boxes (west, south, east, north)
BUILD_BOX = (-75.0, 40.0, -65.0, 48.5)
LIVE_BOX = (-74.0, 40.8, -66.0, 47.7)
TRAIN_BOX = (-74.1, 40.7, -65.8, 47.75)
WATER_BOX = (-75.0, 40.0, -64.0, 48.0)

# fixed values: geometry limits
SIMPLIFY_TOLERANCE_DEG = 0.00022
MAX_CHORD_KM = 20.0
MAX_CHORD_CHECK_KM = 20.05
MAX_DETOUR_RATIO = 1.6
MAX_DETOUR_ALLOWANCE_KM = 5.0
ENDPOINT_TOLERANCE_KM = 0.2
DRY_INTERIOR_DEG = 0.0018
DRY_TERMINAL_DEG = 0.0045
TERMINAL_REACH_DEG = 0.0007
WATER_BUFFER_DEG = 0.00018
CONTROL_INLAND_DEG = 0.0015
EARTH_RADIUS_KM = 6371.0
KM_PER_DEG_LNG = 111.32
KM_PER_DEG_LAT = 110.57

# fixed values: versions written into road geometry rows
ROUTING_VERSION = "osrm-driving-bus-controls-v4"
ROAD_AUDIT_VERSION = "osrm-steps-road-names-v2"
WATER_AUDIT_VERSION = "gshhg-census-water-v1"

# fixed values: seconds after which a row counts as stale, per source
STALE_AFTER_S = {"transit": 90, "regional": 90, "amtrak": 300, "mnr": 120, "ais": 180}
VESSEL_PRUNE_S = 600
LAST_GOOD_HOLD_S = 300
WORK_ZONE_GRACE_S = 15 * 60
WORK_ZONE_HORIZON_S = 7 * 24 * 3600
BADGE_MAJOR = 7
BADGE_MINOR = 4

# fixed values: groups and colours
GROUP_BY_ROUTE_TYPE = {2: "commuter", 3: "bus", 4: "ferry"}
COLOR_BY_ROUTE_TYPE = {2: "#a58add", 3: "#f2b84b", 4: "#2eb7c5"}
COLOR_BY_GROUP = {"amtrak": "#5b9bd5"}
SUPPLEMENT_COLORS = {"bus": "#f2b84b", "ferry": "#2eb7c5", "commuter": "#a58add", "plane": "#9be1ff"}
NO_COLOR = "#8a949f"
SILVER_ROUTES = ["741", "742", "743", "746", "749", "751"]

# fixed values: layer groups (key, routes or route type, counted as vehicles)
LAYER_GROUPS = [
    ("red", ["Red"], None, True),
    ("orange", ["Orange"], None, True),
    ("green", ["Green-B", "Green-C", "Green-D", "Green-E"], None, True),
    ("blue", ["Blue"], None, True),
    ("silver", SILVER_ROUTES, None, True),
    ("mattapan", ["Mattapan"], None, True),
    ("commuter", [], 2, True),
    ("bus", [], 3, True),
    ("amtrak", [], None, True),
    ("local", [], None, False),
    ("ferry", [], 4, True),
    ("plane", [], None, True),
    ("air-service", [], None, False),
    ("airport", [], None, False),
    ("vessel", [], None, True),
    ("bike", [], None, True),
    ("walking", [], None, False),
    ("cycling", [], None, False),
    ("traffic", [], None, False),
    ("roadwork", [], None, False),
    ("incident", [], None, False),
    ("camera", [], None, False),
    ("roads", [], None, False),
    ("freight", [], None, False),
    ("border", [], None, False),
]

# fixed values: commuter lines with estimated positions
ESTIMATED_LINES = {"3": "New Haven", "4": "New Canaan", "5": "Danbury", "6": "Waterbury"}
ESTIMATED_LINE_COLOR = "#ee0034"

# fixed values: compass points to degrees
COMPASS = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5, "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5, "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
}

# fixed values: unit factors
MPS_TO_MPH = 2.23694
KNOTS_TO_MPH = 1.15078
METERS_PER_MILE = 1609.344

# fixed values: facility, ownership, road and rail codes
FACILITY_TYPES = {
    "A": "Airport", "B": "Balloonport", "C": "Seaplane base", "G": "Gliderport", "H": "Heliport",
    "U": "Ultralight facility",
}
OWNERSHIP_TYPES = {"PU": "Publicly owned", "PR": "Privately owned", "MA": "Military"}
ROAD_TYPES = {"I": "Interstate highway", "U": "U.S. highway", "S": "State route"}
RAIL_TYPES = {"M": "main rail network", "I": "major industrial lead", "S": "passing siding"}

# fixed values: text patterns
FERRY_NAME = r"(?i)ferry|seastreak|steamship|island queen|cape flyer"
ALERT_SEVERE = r"(?i)suspend|no service|cancel"
ALERT_DELAY = r"(?i)delay|late|reduced|modified|replacement bus"
RESTRICTED_ROAD = (
    r"(?i)\b(?:Merritt|Wilbur Cross|Hutchinson River|Saw Mill River|Henry Hudson|Mosholu|"
    r"Palisades Interstate|Taconic State|Bronx River|Belt|Cross Island|Jackie Robinson|"
    r"Grand Central|Cross County|Sprain Brook|Bear Mountain|Lake Welch|Pelham|Ocean|"
    r"Korean War Veterans) (?:Parkway|Pkwy)\b|"
    r"\b(?:FDR|Franklin D\.? Roosevelt|Harlem River) (?:Drive|Dr)\b"
)
RESTRICTED_REF = r"(?i)(?:^|[;,\s])CT[- ]?15(?:$|[;,\s])"
RESTRICTED_REF_SOUTH = 41.65
RESTRICTED_REF_WEST = -72.75
RESTRICTED_REF_KM = 8.0

# fixed values: notes
ROAD_NOTE = "Approximate road-following path from published stops; the carrier may use a different roadway."
WATER_NOTE = "Approximate water path between published terminals; actual vessel tracks vary."
SCHEDULE_NOTE = "Published schedule route · live vehicle position shown separately when available"
ROAD_GEOMETRY_PROVIDER = "OpenStreetMap / Project OSRM"
DEFAULT_PROVIDER = "Agency schedule · GTFS"
DEFAULT_SOURCE_URL = "https://mobilitydatabase.org/"

# fixed values: required sets
REQUIRED_TRAINS = [
    "Acela", "Amtrak Hartford Line", "Downeaster", "Ethan Allen Express", "Lake Shore Limited",
    "Northeast Regional", "Valley Flyer", "Vermonter",
]
REQUIRED_VT_TRAINS = ["Ethan Allen Express", "Vermonter"]
REQUIRED_VT_STATIONS = [
    "BLF", "BRA", "BTN", "CNV", "ESX", "MBY", "MPR", "RPH", "RUD", "SAB", "VRN", "WAB", "WNM", "WRJ",
]
REQUIRED_ROAD_ROUTED = [
    "greyhound-flix:2610", "greyhound-flix:2611", "greyhound-flix:2614", "greyhound-flix:2681",
    "greyhound-flix:N2605", "greyhound-flix:US0231", "greyhound-flix:US0235", "boston-express:BX3N",
    "boston-express:BX3S", "boston-express:BX93N", "boston-express:BX93S", "dartmouth-coach:boston-logan",
    "dartmouth-coach:nyc",
]
REQUIRED_WATER_SERVICES = [
    "Boston Water Taxi", "Red Top Boats water taxi", "Island Transporter", "Quicksilver Water Taxi",
    "Bass Harbor Island Cruises", "Cadillac Water Taxi", "Spring Beach Ferry", "Spirit of Ethan Allen",
    "Buttercup Cruises",
]
FERRY_SERVICE_CLASSES = ["international", "island-access", "lifeline", "municipal", "regional", "venue-access"]
CATALOG_FLOORS = {"airport": 750, "airport_public": 170, "ferry_supplement": 50}
CATALOG_EXACT = {"border": 38, "air-service": 11}

# fixed values: names in the border directory
BORDER_PROVINCES = ("QC", "NB")
PORTS_OF_THE_REGION = (" ME", ",ME", "MAINE", " VT", ",VT", "VERMONT", " NH", ",NH", "PITTSBURG")
VERMONT_PORTS = ("VERMONT", " VT", ",VT")
NEW_HAMPSHIRE_PORTS = ("NEW HAMPSHIRE", " NH", ",NH", "PITTSBURG")
CLOSED_PORT = "NO PERMISSIBLE ENTRY"
ROAD_SERVICES = ("HWY/B", "CLVS")
RAIL_SERVICES = ("RAIL",)
FERRY_SERVICES = ("FERRY",)
# west, south, east, north of usable geocodes
GEOCODE_BOX = (-74.0, 44.8, -66.0, 47.6)
