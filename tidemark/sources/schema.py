"""The tables' declared columns; every column may be null, and a column that a file lacks reads as null."""

from __future__ import annotations

from pyspark.sql.types import StructType

_TABLES = {
    "matches": "match_id string, source_file string, event_window_id string, region string, session_date string, match_date string, is_server_replay boolean, replay_timestamp string, length_s double, season string, branch string, network_version bigint, changelist bigint, engine_network_version bigint, is_encrypted boolean, recorded_on string, playlist string, tournament_round int, max_players int, aircraft_start_t double, safe_zones_start_t double, match_end_t double, winning_team bigint, n_players bigint, n_humans bigint, n_teams bigint, lobby_strength double, lobby_strength_source string, lobby_pr_mean double",
    "players": "match_id string, id bigint, player_id string, name string, is_bot boolean, team_index bigint, placement bigint, kills bigint, team_kills bigint, death_t double, death_cause int, death_x double, death_y double, death_z double, disconnected boolean, platform string, raw_location_samples bigint, placement_inferred boolean, team_placement bigint, pr_rank double, pr_score double, leaderboard_rank double, leaderboard_points double",
    "teams": "match_id string, team_index bigint, placement bigint, team_kills bigint, n_players bigint, player_ids string, team_placement bigint",
    "zones": "match_id string, phase bigint, cur_x double, cur_y double, cur_r double, next_x double, next_y double, next_r double, start_shrink_t double, finish_shrink_t double",
    "zone_offsets": "match_id string, phase bigint, cur_x double, cur_y double, cur_r double, next_x double, next_y double, next_r double, start_shrink_t double, finish_shrink_t double, dx double, dy double, dist double, offset_ratio double, shrink_ratio double, allowed double, kind string, u double, angle_deg double, wait_s double, overlap double, zone_type string",
    "bus": "match_id string, bus_source string, start_x double, start_y double, end_x double, end_y double, bearing_deg double, speed double, drop_start_x double, drop_start_y double, drop_end_x double, drop_end_y double, flight_start_t double, drop_start_t double, drop_end_t double, n_points bigint, fit_rms double, direction_known boolean",
    "positions": "match_id string, id bigint, t double, x double, y double, z double, vx double, vy double, vz double, in_storm boolean, dbno boolean, skydiving boolean, team_index bigint",
    "kills": "match_id string, t double, victim_id bigint, finisher_id bigint, downed boolean, revived boolean, distance double, death_cause int, x double, y double, z double",
    "eliminations": "match_id string, time_s double, eliminated string, eliminator string, knocked boolean, gun_type int",
    "landings": "match_id string, id bigint, land_t double, land_x double, land_y double, land_z double, jump_t double, glide_s double, team_index bigint, death_t double, placement bigint, kills bigint, team_placement bigint, pr_rank double, opp_150m bigint, opp_300m bigint, opp_top1000_300m bigint, nearest_opp_m double, bus_offset_m double, bus_along_m double, outside_zone1_m double, outside_zone2_m double, poi string, poi_m double, off_spawn boolean, early_kills bigint, final bigint",
    "pois": "name string, x double, y double, z double, kind string, id string, fetched string",
    "health": "match_id string, t double, id bigint, health double, shield double",
    "damage": "match_id string, t double, attacker_id bigint, target_id bigint, target_kind string, amount double, shield_hit boolean, shield_destroyed boolean, fatal boolean, critical boolean, x double, y double, z double",
    "chests": "match_id string, t double, container string, kind string, tier string, searched_by bigint, x double, y double, z double, opener_inferred boolean",
    "pickups": "match_id string, spawn_t double, item string, category string, rarity string, count bigint, x double, y double, z double, tossed boolean, picked_t double, picked_by bigint, gone_t double, taker_inferred boolean",
    "weapons_held": "match_id string, t double, id bigint, weapon string, category string, rarity string",
    "builds": "match_id string, t double, kind string, material string, team_index bigint, player_placed boolean, max_health double, x double, y double, z double, destroyed_t double",
}
NAMES = tuple(_TABLES)
#: Columns of the packed event tables, and one more that only feeds the health rebuild.
ATTRIBUTES = "match_id string, t double, id bigint, handle bigint, value double"


def schema(name: str) -> StructType:
    return StructType.fromDDL(ATTRIBUTES if name == "attributes" else _TABLES[name])


#: A parsed match: nested document with column-packed tables.
_PACKED = "struct<columns:array<string>,rows:array<array<string>>>"
DOCUMENT = (
    "schema string, match_id string, source_file string, "
    "replay struct<length_ms:bigint,network_version:bigint,changelist:bigint,timestamp:string,is_encrypted:boolean,branch:string,engine_network_version:bigint,platform:string>, "
    "game struct<playlist:string,tournament_round:int,team_size:int,max_players:int,aircraft_start_t:double,safe_zones_start_t:double,match_end_t:double,winning_team:bigint>, "
    "bus array<struct<start:array<double>,yaw:double,speed:double,time_till_flight_end:double,flight_start_time:double,flight_end_time:double,drop_start_time:double,drop_end_time:double>>, "
    "zones array<struct<seq:int,radius:double,start_shrink_t:double,finish_shrink_t:double,last_center:array<double>,last_radius:double,next_center:array<double>,next_radius:double,next_next_radius:double>>, "
    "players array<struct<id:bigint,player_id:string,name:string,is_bot:boolean,team_index:bigint,placement:bigint,kills:bigint,team_kills:bigint,death_t:double,death_cause:int,death_location:array<double>,disconnected:boolean,platform:string,location_samples_raw:bigint>>, "
    "teams array<struct<team_index:bigint,placement:bigint,team_kills:bigint,player_ids:array<bigint>>>, "
    f"positions {_PACKED}, "
    "kill_feed array<struct<t:double,victim_id:bigint,finisher_id:bigint,downed:boolean,revived:boolean,distance:double,death_cause:int,location:array<double>>>, "
    "eliminations array<struct<time:string,eliminated:string,eliminator:string,knocked:boolean,gun_type:int>>, "
    f"events struct<health:{_PACKED},damage:{_PACKED},chests:{_PACKED},pickups:{_PACKED},weapons_held:{_PACKED},builds:{_PACKED},attributes:{_PACKED}>"
)
