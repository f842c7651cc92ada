"""Weights of the field over DOM leaf blocks, as htmltext.trained() gives them: by feature, for label 1 (its opposite for 0)."""

WEIGHTS = {
    "at:0": -1.067158,
    "at:1": -0.378406,
    "at:2": -0.269261,
    "at:3": -0.431499,
    "at:4": -0.879206,
    "bias": -1.591923,
    "end:other": -1.567085,
    "end:stop": -0.227784,
    "few": 1.483499,
    "few:other": 0.81202,
    "few:own": 0.672729,
    "hint:ad": -2.139365,
    "hint:foot": -0.868147,
    "hint:form": -0.818134,
    "hint:head": -2.214217,
    "hint:main": 0.718345,
    "hint:nav": -0.400076,
    "hint:note": -1.519971,
    "hint:reply": -5.034125,
    "hint:side": -1.102253,
    "home:0": -0.054379,
    "home:0:short": -0.054379,
    "home:1": 0.493989,
    "home:1:long": 0.026573,
    "home:1:short": 0.506125,
    "home:2": -0.223946,
    "home:2:links": -0.000229,
    "home:2:long": -0.192099,
    "home:2:short": -0.036039,
    "home:3": -0.436085,
    "home:3:links": -0.895528,
    "home:3:long": -0.14582,
    "home:3:short": 0.598017,
    "home:none": -0.875682,
    "home:none:links": -2.333883,
    "home:none:long": -1.5e-05,
    "home:none:short": 1.443399,
    "home:out": -0.847514,
    "home:out:links": -1.090508,
    "home:out:long": 0.162263,
    "home:out:short": 0.004144,
    "in:article": 1.938865,
    "in:aside": -1.351743,
    "in:blockquote": 1.697508,
    "in:body": -1.69549,
    "in:button": -1.083654,
    "in:dialog": -0.757614,
    "in:div": 0.333115,
    "in:footer": -0.75108,
    "in:form": -1.552623,
    "in:h1": 1.318634,
    "in:h2": 0.757198,
    "in:h3": -1.356518,
    "in:header": -1.657782,
    "in:hidden": -6.752766,
    "in:li": -2.874784,
    "in:main": 2.16501,
    "in:nav": -0.892759,
    "in:p": -0.306563,
    "in:pre": 1.669026,
    "in:section": -4.0134,
    "in:table": 0.706996,
    "in:td": 0.706996,
    "in:ul": 3.684388,
    "links:0": 1.833507,
    "links:3": -4.306185,
    "mark": -3.384495,
    "near:": 1.935686,
    "near:ad": -2.139365,
    "near:article": 2.25448,
    "near:aside": -0.975502,
    "near:blockquote": 1.697508,
    "near:button": -1.083654,
    "near:dialog": -0.651005,
    "near:foot": -0.868147,
    "near:footer": -0.567002,
    "near:form": -1.24812,
    "near:h1": 1.318634,
    "near:h2": 0.757198,
    "near:h3": -1.356518,
    "near:head": -0.039875,
    "near:header": -0.002594,
    "near:main": 1.986342,
    "near:nav": -1.292765,
    "near:note": -1.084844,
    "near:pre": 1.669026,
    "near:reply": -1.621352,
    "near:side": -1.007149,
    "own:article": -0.374427,
    "own:aside": -0.395217,
    "own:button": -1.083654,
    "own:dialog": -0.320362,
    "own:div": -2.149949,
    "own:footer": -0.159285,
    "own:form": -0.600133,
    "own:h1": 1.318634,
    "own:h2": 0.757198,
    "own:h3": -1.356518,
    "own:li": 2.286783,
    "own:p": -0.306563,
    "own:pre": 1.669026,
    "own:section": -0.307255,
    "own:td": -0.915487,
    "prose": -0.114627,
    "size:0": -0.746519,
    "size:1": -0.986147,
    "size:2": -0.045537,
    "size:3": 0.093366,
    "size:4": -0.267507,
    "size:5": -0.004582,
}
#: By label before and label.
MOVES = [[-1.076584, -0.400907], [-1.342514, 2.820005]]
