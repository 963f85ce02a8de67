"""DataFrame transforms: facets, rollups, state, matching, ranking, audits."""
