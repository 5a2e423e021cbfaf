"""Part of the newsquant library."""
