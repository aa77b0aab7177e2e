"""Where catalogs and changelogs come from and go to."""
