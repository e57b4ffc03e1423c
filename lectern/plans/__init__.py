"""Questions to plans, and the projection of star-schema tables onto the catalogue model."""
