"""Channel map: which module, type and position every channel has."""

from hitframe.maps.channel_map import (  # noqa: F401
    Layout,
    channel_listing,
    channel_map,
    configured_channel_map,
    duplicate_channels,
    module_collisions,
)
from hitframe.maps.config import MapConfig, load_config, read_run_config  # noqa: F401
from hitframe.maps.tables import (  # noqa: F401
    bounded_decompression,
    bounded_regions,
    module_ids,
    type_channels,
    typed_module_ids,
)
