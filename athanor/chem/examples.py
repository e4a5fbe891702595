"""Worked examples of products, paths and symmetry, as (rule or catalog, molecule, molecule)."""

PRODUCTS = (
    ("Hydroxylation", "CC", "CCO"),
    ("Dehydrogenation", "CCC", "C=CC"),
    ("Dehydrogenation", "OC=CO", "O=CC=O"),
    ("Dehydrogenation", "OC=CC=CC=CC=CN", "N=CC=CC=CC=CC=O"),
    ("QuinoneFormation", "Oc1ccc(O)cc1", "O=C1C=CC(=O)C=C1"),
    ("QuinoneFormation", "CC(=O)Nc1ccc(O)cc1", "CC(=O)N=C1C=CC(=O)C=C1"),
    ("QuinoneFormation", "COc1ccc(c(c1)C(C)(C)C)O", "O=C1C=CC(=O)C(=C1)C(C)(C)C"),
    ("Hydrogenation", "CC(=O)N=C1C=CC(=O)C=C1", "CC(=O)Nc1ccc(O)cc1"),
    ("Epoxidation", "C=Cc1ccccc1", "C1OC1c1ccccc1"),
    ("Epoxidation", "CC=C", "CC1CO1"),
    ("EpoxideOpening", "C1=CC=CC2OC12", "C1=CC=CC(O)C1O"),
    ("Hydrolysis", "C1=CC=CC=C1C(=O)OC(C)(C)C", "O=C(O)c1ccccc1"),
    ("Dealkylation", "C1CCNC1", "O=CCCCN"),
    ("Dealkylation", "Clc1ccc(cc1)C(c1ccccc1)C", "Clc1ccc(cc1)C(=O)c1ccccc1"),
    ("Dehydration", "Oc1ccccc1", "c1ccccc1"),
    ("ReductiveDehalogenation", "BrCCCCCBr", "CCCCCBr"),
    ("Dephosphorylation", "O=P(O)(O)OC", "CO"),
    ("NitrogenOxidation", "CCCN", "CCCNO"),
    ("Tautomerization", "O=C1CCCCC1", "OC1=CCCCC1"),
    ("Tautomerization", "Oc1ccccc1", "O=C1CC=CC=C1"),
)

#: (name, reactant, target) of searches by size.
MID = (
    ("eugenol", "COc1ccc(CC=C)cc1O", "O=C1C=CC(=O)C(CC=C)=C1"),
    ("dimethoxy", "COc1ccc(CCN)cc1OC", "NCCc1ccc(O)c(O)c1"),
    ("methoxyphenol", "COc1ccc(O)cc1", "O=C1C=C(O)C(=O)C(O)=C1"),
    ("enyne", "CN(CC=CC#CC(C)(C)C)Cc1cccc2ccccc12", "C(#CC=CC=O)C(C)(C)C"),
    ("naphthoquinone", "COc1ccc2ccccc2c1", "O=C1C(=O)c2ccccc2C=C1"),
)
LARGER = (
    ("dialdehyde", "CN(C)Cc1ccc(CN(C)Cc2ccc(C(C)(C)C)cc2)cc1", "O=Cc1ccc(C=O)cc1"),
    ("macrocycle", "C1CCCCCCNC2CCCC(CC2)NCCCC1", "NC1CCCC(=O)CC1"),
    ("tribenzyl", "N(Cc1ccccc1)(Cc1ccccc1)Cc1ccccc1", "O=Cc1ccccc1"),
    ("triphenyl", "c1ccccc1CCCCc2ccccc2CCCCc3ccccc3", "Oc1ccccc1CCCCc2ccccc2CCCCc3ccccc3"),
    ("diphenyl", "COc1ccc(Cc2ccc(OC)cc2)cc1", "Oc1ccc(Cc2ccc(O)cc2)cc1"),
)
HARD = (
    ("trimethoxy", "COc1cc(OC)c(OC)c(CCN)c1", "NCCc1cc(O)c(O)c(O)c1"),
    ("dimethoxyallyl", "COc1cc(CC=C)cc(OC)c1O", "O=C1C=C(CC=C)C(=O)C(O)=C1"),
    ("bismethoxy", "COc1ccc2c(OC)cccc2c1", "O=C1C(=O)c2ccccc2C=C1"),
    ("biphenyl", "COc1ccc(-c2ccc(OC)c(OC)c2)cc1OC", "Oc1ccc(-c2ccc(O)c(O)c2)cc1O"),
    ("veratrole", "COc1ccc(CC=C)c(OC)c1OC", "O=C1C=C(CC=C)C(=O)C(O)=C1"),
    ("tetramethoxynaphthalene", "COc1cc(OC)c2c(OC)cc(OC)cc2c1", "O=C1C=C(O)C(=O)c2c(O)cc(O)cc12"),
)

_GS = "SCC(NC(=O)CCC(N)C(=O)O)C(=O)NCC(=O)O"

#: All products of a leaf rule on a molecule, one text per outcome with its parts joined by ".".
EXACT = (
    ("Hydroxylation", "CCO", ("CC(O)O", "OCCO")),
    ("Hydroxylation", "c1ccccc1", ("Oc1ccccc1",)),
    ("Hydroxylation", "CC(C)C", ("CC(C)(C)O", "CC(C)CO")),
    ("Dehydrogenation", "CCO", ("C=CO", "CC=O")),
    ("Dehydrogenation", "CCC", ("C=CC",)),
    ("Dehydrogenation", "Oc1ccc(O)cc1", ("O=C1C=CC(=O)C=C1",)),
    ("QuinoneFormation", "c1ccccc1", ("O=C1C=CC(=O)C=C1", "O=C1C(=O)C=CC=C1")),
    ("QuinoneFormation", "Oc1ccccc1", ("O=C1C=CC(=O)C=C1", "O=C1C(=O)C=CC=C1", "O=C1C=CC(=O)C(O)=C1", "O=C1C(=O)C=CC(O)=C1", "O=C1C(=O)C=CC=C1O")),
    ("Dealkylation", "CCO", ("C.OC=O", "C.OCO", "C=O.CO", "CO.CO")),
    ("Dealkylation", "COC", ("CO.OC=O", "C=O.CO", "CO.CO")),
    ("NDealkylation", "CN(C)C", ("CNC.OC=O", "C=O.CNC", "CNC.CO")),
    ("NDealkylation", "CCN", ("CC(=O)O.N", "CC=O.N", "CCO.N")),
    ("AzoSplitting", "c1ccccc1N=Nc1ccccc1", ("Nc1ccccc1.Nc1ccccc1",)),
    ("AzoSplitting", "N=Nc1ccccc1", ("N.Nc1ccccc1",)),
    ("BenzodioxoleReduction", "c1ccc2c(c1)OCO2", ("C.Oc1ccccc1O",)),
    ("NitroaromaticReduction", "[O-][N+](=O)c1ccccc1", ("O.O=Nc1ccccc1",)),
    ("ThiopheneSulfurOxidation", "c1ccsc1", ("[O-][S+]1C=CC=C1",)),
    ("Dephosphorylation", "COP(=O)(O)O", ("CO.O=P(O)O",)),
    ("EpoxideOpening", "C1OC1", ("CCO", "OCCO")),
    ("EpoxideOpening", "CC1CO1", ("CC(C)O", "CCCO", "CC(O)CO")),
    ("Hydrolysis", "CC(=O)OC", ("CC(=O)O.CO", "CC=O.CO")),
    ("Hydrolysis", "CC(=O)NC", ("CC(=O)O.CN", "CC=O.CN")),
    ("Dehydration", "CCO", ("C=C.O", "CC.O")),
    ("Hydrogenation", "C=C", ("CC",)),
    ("Hydrogenation", "C#C", ("C=C",)),
    ("Tautomerization", "O=C1CCCCC1", ("OC1=CCCCC1",)),
    ("NitrogenReduction", "CCNO", ("CCN.O",)),
    ("NitrogenReduction", "[O-][N+](=O)c1ccccc1", ("Nc1ccccc1.O.O", "O.O=Nc1ccccc1")),
    ("OxygenReduction", "CC=O", ("CCO",)),
    ("OxygenReduction", "CC(=O)OC", ("COC(C)O",)),
    ("ReductiveDehalogenation", "CCCl", ("C=C.Cl", "CC.Cl")),
    ("ReductiveDehalogenation", "Clc1ccccc1", ("Cl.c1ccccc1",)),
    ("SulfurReduction", "CS(=O)C", ("CSC.O", "C.CS=O")),
    ("SulfurReduction", "CSSC", ("CS.CS", "C.CSS")),
    ("Epoxidation", "C=C", ("C1CO1",)),
    ("Epoxidation", "c1ccccc1", ("C1=CC=CC2OC12",)),
    ("EpoxideHydration", "C=C", ("OCCO",)),
    ("EpoxideHydration", "c1ccccc1", ("OC1C=CC=CC1O",)),
    ("SulfurOxidation", "CSC", ("CS(C)=O", "CS(C)O", "C[S+](C)[O-]")),
    ("NitrogenOxidation", "CCN", ("CCN=O", "CCNO")),
    ("NitrogenOxidation", "CN(C)C", ("C[N+](C)(C)[O-]",)),
    ("NitrogenOxidation", "c1ccncc1", ("[O-][n+]1ccccc1",)),
    ("OxidativeDehalogenation", "CCCl", ("CC(=O)O.Cl", "CCO.Cl")),
    ("OxidativeDehalogenation", "Clc1ccccc1", ("Cl.Oc1ccccc1", "Oc1ccccc1Cl")),
    ("Acetylation", "CCO", ("CCOC(C)=O",)),
    ("Acetylation", "Nc1ccccc1", ("CC(=O)Nc1ccccc1",)),
    ("Sulfation", "CCO", ("CCOS(=O)(=O)O",)),
    ("Glucuronidation", "CCO", ("CCOC1OC(C(=O)O)C(O)C(O)C1O",)),
    ("Glutathionation", "C=C", ("CC" + _GS,)),
    ("Glutathionation", "C1OC1", ("OCC" + _GS,)),
    ("GlutathionationNoThiol", "C1OC1", ("OCC" + _GS,)),
    ("GSH", "CCS", ("CCS" + _GS,)),
    ("Protein", "C1OC1", ("OCCSCC(N)C(=O)O",)),
    ("Protein", "CCS", ("CCSSCC(N)C(=O)O",)),
    ("DNA", "C=C", ("CCn1cnc2c1nc(N)[nH]c2=O",)),
    ("Cyanide", "C1OC1", ("N#CCCO",)),
    ("Cyanide", "CC=O", ("CC(O)C#N",)),
    ("Cyanide", "CCCl", ("CCC#N.Cl",)),
    ("Cyanide", "Clc1ccccc1", ("Cl.N#Cc1ccccc1",)),
    ("Cyanide", "CC=CC=O", ("CC(C#N)C=CO", "CC=CC(O)C#N")),
    ("Cyanide", "CN=C=O", ("CNC(=O)C#N",)),
    ("Cyanide", "CCOS(C)(=O)=O", ("CCC#N.CS(=O)(=O)O",)),
    ("Cyanide", "CC1CN1", ("CC(CN)C#N", "CC(N)CC#N")),
)

#: (molecule, query, raw matches, sites, sizes of the sites' orbits)
SITES = (("CCC", "[#6H2,#6H3:1]", 3, 2, "1,2"), ("c1ccccc1", "[c:1]", 6, 1, "6"))
