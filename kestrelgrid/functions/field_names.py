"""Field names of exported logs and the quantities they carry."""

from __future__ import annotations

import re

# A quantity and the names it goes by, as normal() writes them.
QUANTITIES = {
    "time": ["time", "time_stamp", "timestamp", "elapsed_time", "t", "t_s", "time_s", "video_time_s", "time_ms", "offset_time"],
    "latitude": ["lat", "latitude", "drone_lat", "gps_lat"],
    "longitude": ["lon", "lng", "longitude", "drone_lon", "drone_lng", "gps_lon"],
    "alt_msl": ["alt_msl", "abs_alt", "altitude", "altitude_above_sea_level", "drone_altitude", "drone_altitude_m", "alt", "ele"],
    "alt_rel": ["alt_rel", "rel_alt", "relative_altitude", "height", "height_above_takeoff"],
    "yaw": ["yaw", "heading", "gimbal_yaw", "gimbal_heading", "compass_heading"],
    "pitch": ["pitch", "gimbal_pitch"],
    "roll": ["roll", "gimbal_roll"],
    "accuracy_h": ["accuracy_h", "h_acc", "horizontal_accuracy", "eph", "gps_h_acc", "rtk_std_h"],
    "accuracy_v": ["accuracy_v", "v_acc", "vertical_accuracy", "epv", "gps_v_acc", "rtk_std_hgt"],
    "satellites": ["satellites", "sat_count", "n_sats", "num_sats", "sats"],
    "fix": ["fix_type", "gps_status", "rtk_fix", "fix", "gps_level"],
    "is_video": ["is_video", "recording"],
    "segment_no": ["segment_no", "seg", "clip_index", "segment", "segment_index"],
    "start": ["start", "start_s", "start_sec", "segment_start_s", "begin_s", "from_s", "begin"],
    "end": ["end", "end_s", "end_sec", "segment_end_s", "until_s", "to_s"],
    "duration": ["duration", "duration_s", "duration_sec", "length_s"],
    "clip": ["clip", "clip_name", "file_name"],
    "camera": ["camera", "camera_serial"],
}
_BY_NAME = {name: quantity for quantity, names in QUANTITIES.items() for name in names}


def unit_of(name: str) -> str:
    """What a name holds in brackets at its end, in lower case; '' where nothing."""
    found = re.search(r"[(\[]([^()\[\]]*)[)\]]\s*$", name)
    return found.group(1).strip().lower() if found else ""


def normal(name: str) -> str:
    """A name without unit, in lower case, its words joined by underscores: altitude_above_seaLevel(feet), hAcc(mm)."""
    bare = re.sub(r"[(\[][^()\[\]]*[)\]]\s*$", "", name)
    bare = re.sub(r"([a-z])([A-Z])", r"\1_\2", bare)
    return re.sub(r"[^0-9a-z]+", "_", bare.lower()).strip("_")


def quantity_of(path: str) -> str:
    """The quantity of a field, by its dotted path as a whole, else by its last name, else its own normal name."""
    whole = normal(path)
    return _BY_NAME.get(whole) or _BY_NAME.get(normal(path.rpartition(".")[2])) or whole


def quantities_of(paths: list[str]) -> list[str]:
    """Quantities of the fields of one file; of several names of one quantity all but the first stand for themselves."""
    seen: set[str] = set()
    out = []
    for path in paths:
        quantity = quantity_of(path)
        out.append(f"{quantity}:{path}" if quantity in seen else quantity)
        seen.add(quantity)
    return out
