"""Part of loomstead."""
