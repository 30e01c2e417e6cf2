"""DataFrame operators over (scene_id, row, col) tables."""
