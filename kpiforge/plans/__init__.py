"""Plans: the star-schema build and the KPI result sets."""
