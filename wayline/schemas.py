"""Explicit schemas of the sources and of the position table."""

# id, source, group, truth status, position, freshness and display text of one moving or fixed thing
FIX_COLUMNS = [
    ("id", "string"), ("source", "string"), ("grp", "string"), ("data_status", "string"), ("lng", "double"), ("lat", "double"),
    ("bearing", "double"), ("has_bearing", "boolean"), ("stale", "boolean"), ("title", "string"), ("dest", "string"),
    ("status", "string"), ("meta", "string"), ("provider", "string"), ("source_url", "string"), ("updated_at", "timestamp"),
    ("color", "string"),
]
FIX = ", ".join(f"{n} {t}" for n, t in FIX_COLUMNS)

GTFS = {
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type string, route_url string",
    "trips": "trip_id string, route_id string, shape_id string, direction_id string",
    "shapes": "shape_id string, shape_pt_lat string, shape_pt_lon string, shape_pt_sequence string",
    "stops": "stop_id string, stop_name string, stop_code string, stop_url string, stop_lat string, stop_lon string",
    "stop_times": "trip_id string, stop_id string, stop_sequence string",
    "feed_info": "feed_publisher_name string, feed_version string, feed_start_date string, feed_end_date string",
}

STATIC_FEED = (
    "id string, agency string, url string, states array<string>, route_name_pattern string, route_name_field string, "
    "group_override string, group_color string, provider string, source_url string, route_type_override int, "
    "include_stations boolean, shape_only boolean, require_region_match boolean, record_feed_info boolean, "
    "use_route_urls boolean, required boolean, agency_names map<string,string>"
)
REALTIME_FEED = "id string, agency string, url string, states array<string>, authorization string"

def _vehicle_message(number: str, time: str) -> str:
    return (
        f"header struct<timestamp:{time}>, entity array<struct<id:string, vehicle:struct<timestamp:{time}, "
        f"position:struct<latitude:{number},longitude:{number},bearing:{number},speed:{number}>, trip:struct<tripId:string,routeId:string>, "
        "vehicle:struct<id:string,label:string>>>>"
    )


VEHICLE_MESSAGE, VEHICLE_NUMBERS = _vehicle_message("string", "string"), _vehicle_message("double", "bigint")
TRIP_MESSAGE = (
    "header struct<timestamp:bigint>, entity array<struct<id:string, tripUpdate:struct<trip:struct<tripId:string,routeId:string>, "
    "stopTimeUpdate:array<struct<stopId:string, arrival:struct<time:bigint>, departure:struct<time:bigint>>>>>>"
)
_TEXT = "struct<translation:array<struct<text:string,language:string>>>"
ALERT_MESSAGE = (
    "header struct<timestamp:bigint>, entity array<struct<id:string, alert:struct<activePeriod:array<struct<start:bigint,`end`:bigint>>, "
    f"informedEntity:array<struct<routeId:string,stopId:string>>, headerText:{_TEXT}, descriptionText:{_TEXT}>>>"
)
AIRCRAFT_MESSAGE = (
    "ac array<struct<hex:string, flight:string, t:string, lat:string, lon:string, track:string, gs:string, seen:string, alt_baro:string>>"
)
TRAIN = (
    "trainID string, trainNum string, routeName string, trainState string, lat string, lon string, heading string, velocity string, "
    "origName string, destName string, updatedAt string, lastValTS string, "
    "stations array<struct<name:string,status:string,schArr:string,arr:string>>"
)
VESSEL_MESSAGE = (
    "MessageType string, MetaData struct<MMSI:bigint,ShipName:string,ShipType:double,latitude:double,longitude:double>, "
    "Message map<string,struct<TrueHeading:double,Cog:double,Sog:double,Type:double,TypeAndCargo:double,ShipType:double,Name:string>>"
)
WORK_ZONE = (
    "id string, geometry struct<type:string,coordinates:string>, properties struct<core_details:struct<road_names:array<string>,"
    "direction:string,update_date:string,description:string>, start_date:string, end_date:string, vehicle_impact:string, "
    "lanes:array<struct<status:string,type:string>>, types_of_work:array<struct<type_name:string>>>"
)
WORK_ZONE_FILE = (
    f"features array<struct<{WORK_ZONE.replace('id string', 'id:string').replace('geometry struct', 'geometry:struct').replace('properties struct', 'properties:struct')}>>, "
    "feed_info struct<update_date:string>, road_event_feed_info struct<update_date:string>"
)
ICONS = "item2 array<struct<itemId:string,location:array<double>>>"
CAMERA_FILE = (
    "features array<struct<id:string, geometry:struct<type:string,coordinates:array<double>>, properties:struct<HOC_Display:string,"
    "Roadway:string,Direction:string,MM:string,Municipality:string,Description:string,Status:string,OBJECTID:string>>>"
)
_STATION = "struct<station_id:string,name:string,lat:double,lon:double,capacity:bigint>"
_STATUS = (
    "struct<station_id:string,num_bikes_available:int,num_ebikes_available:int,num_docks_available:int,is_installed:boolean,"
    "is_renting:boolean,last_reported:string>"
)
_VEHICLE = (
    "struct<bike_id:string,vehicle_id:string,lat:string,lon:string,is_disabled:boolean,is_reserved:boolean,vehicle_type_id:string,"
    "current_range_meters:string,current_fuel_percent:string,last_reported:string>"
)
_VEHICLE_TYPE = "struct<vehicle_type_id:string,form_factor:string,propulsion_type:string>"


def _share(field: str, item: str) -> str:
    inner = f"{field}:array<{item}>"
    return f"last_updated string, data struct<en:struct<{inner}>,{inner}>"


SHARE = {
    "feeds": _share("feeds", "struct<name:string,url:string>"),
    "station_information": _share("stations", _STATION),
    "station_status": _share("stations", _STATUS),
    "vehicle_types": _share("vehicle_types", _VEHICLE_TYPE),
    "free_bike_status": _share("bikes", _VEHICLE),
    "vehicle_status": _share("vehicles", _VEHICLE),
}
_REF = "struct<data:struct<id:string>>"
API_VEHICLES = (
    "data array<struct<id:string, attributes:struct<latitude:double,longitude:double,bearing:double,current_status:string,direction_id:int,"
    f"label:string,updated_at:string,carriages:array<struct<occupancy_percentage:double>>,revenue:string>, relationships:struct<route:{_REF},stop:{_REF}>>>, "
    "included array<struct<id:string,type:string,attributes:struct<name:string>>>"
)
API_ROUTES = (
    "data array<struct<id:string,attributes:struct<type:int,color:string,text_color:string,long_name:string,short_name:string,"
    "direction_destinations:array<string>>>>"
)
API_ALERTS = (
    "data array<struct<id:string,attributes:struct<effect:string,severity:int,header:string,informed_entity:array<struct<route:string,stop:string>>>>>"
)
API_STOPS = "data array<struct<id:string,attributes:struct<latitude:double,longitude:double>>>"
POINT_FEATURES = (
    "features array<struct<id:string,geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>"
)
AIRPORT = (
    "SITE_TYPE_CODE string, FACILITY_USE_CODE string, OWNERSHIP_TYPE_CODE string, ARPT_ID string, ICAO_ID string, ARPT_NAME string, "
    "CITY string, COUNTY_NAME string, STATE_CODE string, ARPT_STATUS string, LAT_DECIMAL string, LONG_DECIMAL string, ELEV string, EFF_DATE string"
)
