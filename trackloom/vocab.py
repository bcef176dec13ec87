"""Buckets, thresholds, phrases and lexicons of the benchmark."""

# fixed values: upper bounds of the four quarters of a video, and of the durations in seconds
TIME_BUCKETS = [("beginning", 0.25), ("early", 0.5), ("late", 0.75), ("end", None)]
DURATION_BUCKETS = [("very briefly", 0.5), ("briefly", 2.0), ("for several seconds", 5.0), ("for an extended period", None)]
# fixed values: event detection
BASELINE_WINDOW, PARTIAL_RATIO, FULL_RATIO = 10, 0.50, 0.10
MIN_PARTIAL, MIN_FULL, MIN_REAPPEAR, BORDER = 2, 2, 2, 0.05
AREA_JUMP, POSITION_JUMP, JUMP_GAP = 0.8, 0.4, 5
OVERLAP_IOU, MIN_OVERLAP, MAX_OVERLAP_SHARE = 0.05, 3, 0.8
OCCLUDER_IOU, OCCLUDER_FRAMES, OCCLUDER_GAP = 0.10, 2, 0.3
# fixed values: track repair
MIN_TRACK_FRAMES, MIN_TRACK_SHARE, MERGE_GAP_S, MERGE_JUMP, SWAP_JUMP, SWAP_FRAMES, CONFIDENT = 5, 0.02, 2, 0.15, 0.35, 3, 0.7
# fixed values: identity candidates and video verdict
SIBLING_COVISIBLE, SIBLING_DISTANCE, SIBLING_HIDDEN_S, FPS = 0.5, 0.10, 1.0, 3
MIN_OBJECTS, MIN_EVENTS, MIN_INTERACTIONS, MIN_SECONDS, MAX_SECONDS = 2, 3, 2, 5, 90
# fixed values: scoring
TIER_WEIGHTS = {"tier1": 0.32, "tier2": 0.43, "tier3": 0.25}
MIN_DIM_ITEMS = 10
# fixed values: event types in the order of detection
EVENT_TYPES = ["appear", "enter_frame", "exit_frame", "partial_occlusion", "full_occlusion", "reappear", "disappear", "state_change", "interaction"]
# fixed values: weights of the video quality score
QUALITY = {"full_occlusion": 5, "reappear": 5, "partial_occlusion": 3, "exit_frame": 3, "enter_frame": 3, "appear": 2, "disappear": 2, "state_change": 1, "interaction": 3}
# fixed values: answers of the kinds of question, and phrases that polishing must keep
TIMES = ["beginning", "early", "late", "end"]
DURATIONS = ["very briefly", "briefly", "for several seconds", "for an extended period"]
DIRECTIONS = ["moves from left to right", "moves from right to left", "moves from top to bottom", "moves from bottom to top", "stays in roughly the same place"]
STATES = ["fully visible", "partly hidden", "fully hidden", "not yet appeared or already gone"]
LOCKS = {
    "temporal_location": TIMES,
    "duration_category": DURATIONS,
    "relative_spatial_change": DIRECTIONS,
    "conditional_state": STATES,
    "reappear_or_disappear": ["fully blocked", "left the frame"],
    "reappear_identity": ["the same one", "a different one"],
}
MADE_UP_A, MADE_UP_B = "there is no", "never"
# fixed values: what events are called in questions; {partner} is the other object's name
VERBS = {
    "full_occlusion": "gets fully hidden", "partial_occlusion": "gets partly hidden", "reappear": "comes back into view", "appear": "first shows up", "disappear": "disappears for good",
    "exit_frame": "leaves the frame", "enter_frame": "enters the frame", "state_change": "changes abruptly", "interaction": "interacts with another object",
}
CONDITIONS = {"full_occlusion": "fully hidden from view", "partial_occlusion": "partly hidden", "exit_frame": "out of the frame", "interaction": "in contact with {partner}"}
# fixed values: tier and format of each dimension; those asked about confident objects only; those whose subject may be made up, and in both ways
DIMENSIONS = {
    "temporal_location": ("tier1", "mcq_4"), "duration_category": ("tier1", "mcq_4"), "relative_spatial_change": ("tier1", "mcq_4"), "event_existence": ("tier1", "sp"), "reappear_or_disappear": ("tier2", "sp"), "event_count": ("tier2", "numerical"),
    "event_ordering": ("tier2", "ordering"), "reappear_identity": ("tier2", "sp"), "occluder_identity": ("tier2", "sp"), "conditional_state": ("tier3", "mcq_4"), "cross_object_order": ("tier3", "sp"),
}
CONFIDENT_DIMS = ["event_count", "event_ordering", "reappear_identity", "occluder_identity", "conditional_state", "cross_object_order"]
MADE_UP_DIMS = ["temporal_location", "duration_category", "relative_spatial_change", "conditional_state"]
MADE_UP_BOTH = ["temporal_location", "duration_category", "conditional_state"]
MADE_UP_RATE, MADE_UP_OPTION_RATE = 0.05, 0.10
