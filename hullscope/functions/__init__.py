"""Part of hullscope; see the modules of this folder."""
